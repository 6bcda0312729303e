"""Media columns: content-addressed payloads in tar shards.

A payload is kept as an 8-bit greyscale PNG of SIDE samples a row, losslessly. Each writing task streams the payloads of
its rows into tar shards of about SHARD_BYTES; the member's name is the SHA-256 of the payload, and a payload that the
shard holds already isn't stored again. Of the MOST_COPIED texts with most copies one row each is chosen to be stored, by
digests alone, which are few enough to be broadcast: texts aren't moved, and a text with copies everywhere is stored once.
Rows carry digest, shard, offset and length; those of such copies are joined from the row that was stored.

Reading back, a header-only range read of the first bytes fills the metadata columns width, height, bit_depth and
colour_type; features come from a range read of the whole member. Each stored payload is read once, by a task over the
rows of some shards; copies get its figures by a join of narrow rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _scan
from tickloom.llm._util import ddl, filesystem, release, stage, workspace
from tickloom.shipping import ship

SIDE, SHARD_BYTES, PAD = 576, 64 << 20, b"\xff"
_SIGN = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: Texts that are stored once in all, those with most copies (24 bytes each); others once for each shard.
MOST_COPIED = 200_000


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, then bytes 255 up to a positive multiple of SIDE."""
    raw = (text or "").encode()
    return raw + PAD * (max(1, -(-len(raw) // SIDE)) * SIDE - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(raw: bytes) -> bytes:
    """A PNG whose samples are these bytes, a multiple of SIDE of them."""
    rows = np.zeros((len(raw) // SIDE, SIDE + 1), dtype=np.uint8)  # each row begins with filter 0
    rows[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, SIDE)
    return _SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(raw: bytes) -> dict:
    """Of the first HEADER_BYTES of a PNG."""
    if raw[:8] != _SIGN or raw[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", raw[16:29])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour, "interlace": interlace}


def decode(raw: bytes) -> bytes:
    """The samples of such a PNG."""
    head, at, body = header(raw), 8, []
    if (head["bit_depth"], head["colour_type"], head["interlace"]) != (8, 0, 0):
        raise ValueError("other than 8-bit greyscale")
    while at < len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        kind, part, crc = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n], struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
        if zlib.crc32(kind + part) != crc:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(head["height"], head["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


class _Tar:
    """A tar shard being written; tells where members' bytes begin."""

    def __init__(self, folder: str):
        self.fs, root = filesystem(folder)
        name = uuid.uuid4().hex
        self.part, self.final, self.uri = f"{root}/.{name}.part", f"{root}/{name}.tar", f"{folder}/{name}.tar"
        self.out, self.at, self.held = self.fs.open_output_stream(self.part), 0, {}

    def put(self, name: str, raw: bytes) -> tuple[int, int]:
        if name not in self.held:
            info = tarfile.TarInfo(f"{name}.png")
            info.size = len(raw)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.held[name] = (self.at + len(head), len(raw))
            body = head + raw + b"\0" * (-len(raw) % 512)
            self.out.write(body)
            self.at += len(body)
        return self.held[name]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()
        self.fs.move(self.part, self.final)


_PLACE = "n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the payloads of docs' texts; the catalogue, a row for each row of docs: doc_id, n_bytes, digest, shard,
    offset, length, and stored, whether the payload was written for this row or for another of the same digest.

    A null text is empty; texts of any length are stored whole. Equal texts have equal digests and bytes. Ids of any type
    and other columns of any name may be there; repeated rows come out as often as they went in. Empty in, empty out. A
    task that is run again writes new shards; the catalogue names those of the attempt that counted.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or workspace(spark, "media")
    fs, root = filesystem(folder)
    fs.create_dir(root)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    same, own = F.unhex(F.md5("text")), F.xxhash64(F.md5("text"), "doc_id")
    copied = docs.groupBy(same.alias("same")).agg(F.min(own).alias("own"), F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "same").limit(MOST_COPIED).toArrow()
    digests = _halves(copied["same"].to_pylist())
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    held = spark.sparkContext.broadcast((digests[order], copied["own"].to_numpy()[order]))

    def chosen(batch):
        """Whether a row is to be stored: all but those of a text with copies, of which one is."""
        (digests, keepers), mine = held.value, _halves(batch.column("same").to_pylist())
        if not len(digests):
            return np.ones(len(mine), dtype=bool)
        at = np.minimum(np.searchsorted(digests[:, 0], mine[:, 0]), len(digests) - 1)
        return (digests[at] != mine).any(axis=1) | (keepers[at] == batch.column("own").to_numpy())

    def run(batches):
        tar = None
        for batch in batches:
            write_all, at = chosen(batch), 0
            for part in _scan.slices(batch, "text"):
                rows, mine = [], write_all[at : at + len(part)].tolist()
                at += len(part)
                for text, write in zip(part.column("text").to_pylist(), mine):
                    raw = payload(text)
                    digest, size = hashlib.sha256(raw).hexdigest(), len(text.encode())
                    if not write:
                        rows.append((size, digest, None, None, None, False))
                        continue
                    if tar is not None and tar.at > SHARD_BYTES:
                        tar.close()
                        tar = None
                    tar = tar or _Tar(folder)
                    offset, length = tar.held.get(digest) or tar.put(digest, encode(raw))
                    rows.append((size, digest, tar.uri, offset, length, True))
                columns = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_bytes", "digest", "shard", "offset", "length", "stored"])
        if tar is not None:
            tar.close()
        tar = batch = part = rows = columns = write_all = text = raw = None
        release()

    rows = docs.select("doc_id", "text", same.alias("same"), own.alias("own"))
    rows = stage(rows.mapInArrow(run, f"doc_id {kind}, {_PLACE}, stored boolean"), "catalogue")
    held.unpersist()
    places = canonical(rows.where("stored").join(rows.where("NOT stored").select("digest").distinct(), "digest", "left_semi")).toDF("c_digest", "c_shard", "c_offset", "c_length")
    others = rows.where("NOT stored").join(stage(places, "places"), F.col("digest") == F.col("c_digest"), "left")
    others = others.select("doc_id", "n_bytes", "digest", F.col("c_shard").alias("shard"), F.col("c_offset").alias("offset"), F.col("c_length").alias("length"), "stored")
    return rows.where("stored").union(others)


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def canonical(catalogue: DataFrame) -> DataFrame:
    """One place for each digest: the least of its shards."""
    return catalogue.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def _reads(catalogue: DataFrame, schema: str, make) -> DataFrame:
    """catalogue with what make() says of its places; a place is read once for each run of rows with it. make() gets a
    function that reads bytes of the shard at an offset, the offset and the length."""
    ship(catalogue.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches):
        shard, file, known = None, None, {}
        for batch in batches:
            rows = []
            for s, offset, n in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length")]):
                if s != shard:
                    fs, at = filesystem(s)
                    shard, file, known = s, fs.open_input_file(at), {}
                if offset not in known:
                    if len(known) > 10_000:
                        known = {}
                    known[offset] = make(file.read_at, offset, n)
                rows.append(known[offset])
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "))]], [*batch.schema.names, *names])
        file = known = batch = rows = columns = None
        release()

    return catalogue.mapInArrow(run, f"{ddl(catalogue)}, {schema}")


def _for_all(catalogue: DataFrame, schema: str, read) -> DataFrame:
    """What read() says of stored rows, for all rows: those of copies join it by digest."""
    names = [x.split()[0] for x in schema.split(", ")]
    own = read(catalogue.where("stored"))
    others = catalogue.where("NOT stored")
    # of the copies' digests alone, one place each
    copied = stage(read(others.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")).select(F.col("digest").alias("d_digest"), *names), "copied")
    others = others.join(copied, F.col("digest") == F.col("d_digest"), "left").drop("d_digest")
    return own.select(*catalogue.columns, *names).union(others.select(*catalogue.columns, *names))


METADATA = "width int, height int, bit_depth int, colour_type int"


def _head(read, offset: int, n: int) -> list:
    """Of a range read of the header alone."""
    head = header(read(min(n, HEADER_BYTES), offset))
    return [head[k] for k in ("width", "height", "bit_depth", "colour_type")]


def _metadata(catalogue: DataFrame) -> DataFrame:
    return _reads(catalogue, METADATA, _head)


def metadata(catalogue: DataFrame) -> DataFrame:
    """catalogue with width, height, bit_depth, colour_type, by reads of HEADER_BYTES a payload."""
    return _for_all(catalogue, METADATA, _metadata)


def _digest(stored: bytes) -> list:
    head, raw = header(stored[:HEADER_BYTES]), decode(stored)
    samples = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    feature = f"png {head['width']}x{head['height']} depth={head['bit_depth']} sum={int(samples.sum(dtype=np.int64))} values={int((counts > 0).sum())} entropy={float(-(p * np.log2(p)).sum()):.6f}"
    return [len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature]


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(catalogue: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the metadata columns of header-only reads, and what the whole stored bytes say: payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature (size and depth from the header; sum, number of values
    and entropy of the samples)."""
    schema = f"{METADATA}, {FEATURES}"
    # one worker for both reads of a payload
    out = _for_all(catalogue, schema, lambda rows: _reads(rows, schema, lambda read, offset, n: [*_head(read, offset, n), *_digest(read(n, offset))]))
    return out.select("doc_id", "n_bytes", *[x.split()[0] for x in schema.split(", ")])
