"""A producer of event dumps that streams can read while it runs: a bounded buffer before sealed segments of JSON lines.

Records are numbered as they come and buffered; the buffer is written when it is full by records or by bytes of text, and
a record whose text alone is over the bound goes straight to the segment after what was buffered. A segment is open under
a hidden name and sealed (written through, then renamed), so a reader sees whole segments only: when it has enough bytes
and the last seal is long enough ago, at a stop, and at the end. Where a write fails half way, the records that were
written are taken off the buffer and the others stay, so a retry repeats none.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.sources import jsonl

#: Which states may follow a state, and what may still be emitted while a profile is finalized.
STATES = {
    "open": {"active", "finalizing", "closed", "failed"},
    "active": {"stopped", "finalizing", "fork_split", "closed", "failed"},
    "stopped": {"active", "finalizing", "closed", "failed"},
    "fork_split": {"active", "open", "closed", "failed"},
    "finalizing": {"closed", "failed"},
    "failed": {"closed"},
    "closed": {"closed"},
}
LATE_TAGS = {"SRC_LINE", "SUB_INFO", "SUB_CALLERS", "PID_END", "ATTRIBUTE", "OPTION", "COMMENT", "DISCOUNT"}
#: Records and bytes of a buffer, by default and at most; seconds and bytes from which on a segment is sealed.
RECORDS, TEXT, MOST_RECORDS, MOST_TEXT = 64, 4096, 4096, 1 << 20
SEAL_SECONDS, SEAL_BYTES = 1.0, 256 << 10


class BadState(RuntimeError):
    """Something that an emitter's state doesn't allow."""


class Emitter:
    """Emits one profile's records into folder/profile_id=.../. clock: seconds, for tests one's own."""

    def __init__(self, folder: str, profile_id: str, *, records: int = RECORDS, text: int = TEXT, clock: Callable[[], float] = time.monotonic):
        if not 0 < records <= MOST_RECORDS or not 0 < text <= MOST_TEXT:
            raise ValueError("a buffer of more records or text than allowed")
        self.folder, self.profile_id, self.records, self.text, self.clock = folder, profile_id, records, text, clock
        self.home = Path(folder) / f"profile_id={profile_id}"
        self.home.mkdir(parents=True, exist_ok=True)
        self.state, self.next_seq = "open", 0
        self.buffer: list[bytes] = []
        self.held = self.dirty = self.segment = 0
        self.sealed_at, self.file = clock(), None
        self.counts = {"high_water": 0, "direct": 0, "seals": 0}

    def _go(self, state: str) -> None:
        if state not in STATES[self.state]:
            raise BadState(f"{self.state} to {state}")
        self.state = state

    def activate(self) -> None:
        """Begin, or go on after a stop."""
        self._go("active")

    def stop(self) -> None:
        """Nothing is emitted until activate(); what was emitted is sealed."""
        self._go("stopped")
        self.seal()

    def finalize(self) -> None:
        """From now on only what sums a profile up."""
        self._go("finalizing")

    def emit(self, tag: str, *args) -> int:
        """The record's number."""
        if self.state not in ("open", "active") and not (self.state == "finalizing" and tag in LATE_TAGS):
            raise BadState(f"{tag} while {self.state}")
        if tag not in schemas.TAGS or len(args) != len(schemas.TAGS[tag]):
            raise ValueError(f"{tag} with {len(args)} arguments")
        line = json.dumps({"args": list(args), "seq": self.next_seq, "tag": tag}, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"
        size = sum(len(a.encode()) for a in args if isinstance(a, str))
        if size > self.text:
            self.flush()
            self._write(line)
            self.counts["direct"] += 1
        else:
            if self.held + size > self.text:
                self.flush()
            self.buffer.append(line)
            self.held += size
        self.next_seq += 1
        if len(self.buffer) >= self.records:
            self.flush()
            self.counts["high_water"] += 1
        return self.next_seq - 1

    def _write(self, line: bytes) -> None:
        if self.file is None:
            self.file = open(self.home / f".{self.segment:08d}.part", "wb")  # noqa: SIM115  open for many writes
        self.file.write(line)
        self.dirty += len(line)

    def flush(self) -> None:
        """Write the buffer, and seal the segment if it is time."""
        done = 0
        try:
            for line in self.buffer:
                self._write(line)
                done += 1
        finally:
            del self.buffer[:done]
            self.held = self.held if self.buffer else 0
        if self.dirty >= SEAL_BYTES and self.clock() - self.sealed_at >= SEAL_SECONDS:
            self.seal()

    def seal(self) -> None:
        """Write all through and give the segment its name. A failure is final: only close() is left."""
        self.flush() if self.buffer else None
        if self.file is None:
            return
        try:
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()
            os.replace(self.file.name, self.home / f"{self.segment:08d}.jsonl")
            at = os.open(self.home, os.O_RDONLY)
            try:
                os.fsync(at)
            finally:
                os.close(at)
        except OSError:
            self.state = "failed"
            raise
        self.file, self.dirty, self.segment, self.sealed_at = None, 0, self.segment + 1, self.clock()
        self.counts["seals"] += 1

    def fork(self, profile_id: str) -> Emitter:
        """The emitter of a child process: all of the parent is written first, and none of it is the child's, whose
        numbers begin with 0."""
        if self.state != "active":
            raise BadState(f"fork while {self.state}")
        self.flush()
        self._go("fork_split")
        child = Emitter(self.folder, profile_id, records=self.records, text=self.text, clock=self.clock)
        child.activate()
        self._go("active")
        return child

    def close(self) -> None:
        """The closing record, and the last segment sealed. A second time does nothing."""
        if self.state == "closed":
            return
        if self.state != "failed":
            self.flush()
            self._write(json.dumps({"args": [], "seq": self.next_seq, "tag": schemas.END}, separators=(",", ":")).encode() + b"\n")
            self.seal()
        self._go("closed")


def read_emitted(spark: SparkSession, folder: str, *, stream: bool = False, files_per_trigger: int = 64) -> DataFrame:
    """The event relation of all emitters' sealed segments in a folder, now or as they come; profile_id is the emitter's."""
    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    rows = source.schema("value string").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(folder)
    name = F.url_decode(F.regexp_extract(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), "profile_id=([^/]+)/", 1))
    return jsonl.parse(rows.select(name.alias("profile_id"), F.col("value").alias("raw")))
