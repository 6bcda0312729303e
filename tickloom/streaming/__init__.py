"""The same folds over streams of landed dumps or event Parquet, and state for processes and sequences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom import functions as fn
from tickloom import schemas
from tickloom.operators.aggregates import P
from tickloom.sources import jsonl


def read_jsonl(spark: SparkSession, path: str, *, mode: str = "FAILFAST", files_per_trigger: int = 64) -> DataFrame:
    """The event relation of dumps as they land in a folder."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return jsonl.parse(text.select(F.col("_metadata.file_path").alias(P), F.regexp_replace("value", "^﻿", "").alias("raw")), mode=mode)


def read_parquet(spark: SparkSession, path: str, *, files_per_trigger: int = 64) -> DataFrame:
    """The event relation from Parquet files as they land."""
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def line_totals(events: DataFrame) -> DataFrame:
    """calls, ticks of each line; for output mode complete or update."""
    return events.where(F.col("tag").isin("TIME_LINE", "TIME_BLOCK")).groupBy(P, "fid", "line").agg(F.count("*").alias("calls"), fn.saturating_sum("ticks").alias("ticks"))


def sub_totals(events: DataFrame) -> DataFrame:
    return events.where("tag = 'SUB_RETURN'").groupBy(P, "name").agg(F.count("*").alias("returns"), F.sum("incl").alias("incl"), F.sum("excl").alias("excl"))


def call_edges(events: DataFrame) -> DataFrame:
    return events.where("tag = 'SUB_CALLERS'").groupBy(P, "caller", "called").agg(fn.saturating_sum("calls").alias("calls"), F.sum("incl").alias("incl"), F.sum("excl").alias("excl"), F.sum("reci").alias("reci"), F.max("depth").alias("max_rec_depth"), F.count("*").alias("sites"))


def last_values(events: DataFrame, tag: str, keys: list[str], values: list[str]) -> DataFrame:
    """Last write by seq; what has come so far decides, and equals the batch result once all has come."""
    return events.where(F.col("tag") == tag).groupBy(P, *keys).agg(F.max_by(F.struct(*values), "seq").alias("v")).select(P, *keys, *[F.col(f"v.{c}").alias(c) for c in values])


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy(P, "tag").agg(F.count("*").alias("events"))


def lifecycle(events: DataFrame) -> DataFrame:
    """profile_id, pid, starts, ends, state (open, closed or unmatched), from state kept for each process: a row whenever
    it changes."""
    rows = events.where(F.col("tag").isin("PID_START", "PID_END")).select(P, "pid", "tag")

    def step(key, frames, state: GroupState):
        starts, ends = state.get if state.exists else (0, 0)
        for f in frames:
            starts += int((f["tag"] == "PID_START").sum())
            ends += int((f["tag"] == "PID_END").sum())
        state.update((starts, ends))
        name = "open" if starts > ends else "closed" if starts == ends else "unmatched"
        yield pd.DataFrame({P: [key[0]], "pid": [key[1]], "starts": [starts], "ends": [ends], "state": [name]})

    return rows.groupBy(P, "pid").applyInPandasWithState(step, f"{P} string, pid long, starts long, ends long, state string", "starts long, ends long", "update", GroupStateTimeout.NoTimeout)


def gaps(events: DataFrame) -> DataFrame:
    """profile_id, seq, expected: records that don't follow the highest one so far by one; each batch is put in order."""

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        seqs = sorted(int(x) for f in frames for x in f["seq"])
        bad = []
        for s in seqs:
            if last is not None and s != last + 1:
                bad.append((key[0], s, last + 1))
            last = s if last is None else max(last, s)
        state.update((last,))
        yield pd.DataFrame(bad, columns=[P, "seq", "expected"])

    return events.select(P, "seq").groupBy(P).applyInPandasWithState(step, f"{P} string, seq long, expected long", "last long", "append", GroupStateTimeout.NoTimeout)


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to several sinks. A batch that is tried again has the same number,
    so sinks that write by it (`to_folder`) keep each batch once."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return each


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Parquet by batch number: a batch that comes again replaces what it wrote."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


class Counting:
    """A sink that writes nothing: records by tag, in all, and without the control record START_DEFLATE, and the highest
    seq. A batch that comes again counts once. Only counts by tag come to the driver."""

    def __init__(self):
        self.batches: dict[int, dict[str, tuple[int, int]]] = {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("tag").agg(F.count("*").alias("n"), F.max("seq").alias("last")).collect()
        self.batches[number] = {r.tag: (r.n, r["last"]) for r in rows}

    @property
    def by_tag(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for one in self.batches.values():
            for tag, (n, _) in one.items():
                out[tag] = out.get(tag, 0) + n
        return out

    @property
    def total(self) -> int:
        return sum(self.by_tag.values())

    @property
    def logical(self) -> int:
        return self.total - self.by_tag.get("START_DEFLATE", 0)

    @property
    def last_seq(self) -> int | None:
        return max((seq for one in self.batches.values() for _, seq in one.values()), default=None)


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """tag, left, right, same_places: where two sinks' records differ in number by tag, or in which seq they have. By
    counts and sums of hashes, so neither side is sorted or joined row by row."""
    place = F.sum(F.xxhash64(P, "seq", "tag").cast("decimal(38,0)"))
    one = lambda e, n: e.where("tag <> 'START_DEFLATE'").groupBy("tag").agg(F.count("*").alias(n), place.alias(f"{n}_places"))
    both = one(left, "left").join(one(right, "right"), "tag", "full")
    both = both.select("tag", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"), F.col("left_places").eqNullSafe(F.col("right_places")).alias("same_places"))
    return both.where("left <> right OR NOT same_places")


def dual(left: str, right: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to two folders, as Parquet and as JSON lines, reads both back and
    fails the batch where they differ. It is tried again with the same number and replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{left}/batch={number}")
            jsonl.lines(batch).select(P, "value").write.mode("overwrite").json(f"{right}/batch={number}")
        finally:
            batch.unpersist()
        first = spark.read.schema(schemas.EVENTS).parquet(f"{left}/batch={number}")
        second = jsonl.parse(spark.read.schema(f"{P} string, value string").json(f"{right}/batch={number}").withColumnRenamed("value", "raw"))
        bad = unequal(first, second).collect()  # a row for each tag at most
        if bad:
            raise RuntimeError(f"batch {number}: the sinks differ in {', '.join(r.tag for r in bad)}")

    return each
