"""Shared helpers: bounded grouped maps, union-find, Bloom filters, ranks without a single task."""

from __future__ import annotations

import ctypes
import gc
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.staging import discard, filesystem, settled, shared_root, stage, workspace  # noqa: F401  for this subpackage


def ddl(df: DataFrame) -> str:
    """df's columns as a schema, for maps that keep them."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def whole(df: DataFrame, name: str = "row"):
    """All columns of df as one struct, so that no name of theirs clashes with one of an operator's own."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(name)


def ranged(df: DataFrame, *order, label: str) -> DataFrame:
    """df dealt out by range of order and staged with `part`, the number of its range: all of a part come before all of
    the next. As it is staged, a range keeps its rows whatever is lost and run again."""
    return stage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


def before(parts: DataFrame, value, *, by: list[str] | None = None) -> DataFrame:
    """by, part, before: the sum of value over the parts before, from a table in which each part has many rows."""
    sums = parts.groupBy(*(by or []), "part").agg(value.alias("part_sum"))
    over = Window.partitionBy(*(by or [])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*(by or []), "part", F.coalesce(F.sum("part_sum").over(over), F.lit(0)).alias("before"))


def grouped(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Pairs (a, b) of bytes that fn(table) returns for each run of equal integer keys, a whole group at a time. Callers
    bound the size of a group (tiles)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held, last, found = [], None, []

        def pairs():
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names)

        def closed():
            if sum(b.num_rows for b in held) > 1:
                found.extend(fn(pa.Table.from_batches(held)))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(len(batch), dtype=bool)
            for v in columns:
                change[1:] |= v[1:] != v[:-1]
            for a, b in itertools.pairwise([0, *np.flatnonzero(change).tolist(), len(batch)]):
                key = tuple(v[a] for v in columns)
                if key != last and held:
                    closed()
                    held = []
                    if len(found) > 1000:
                        yield pairs()
                        found = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            closed()
        if found:
            yield pairs()
        held = found = None
        release()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def release() -> None:
    """Give what a task has freed back to the system: Python workers outlive tasks, and their memory counts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


class Forest:
    """Union-find over 0..n-1 in which the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


BLOOM_MOST_BITS = 1 << 27


class Bloom:
    """A Bloom filter over a long column of well-mixed hashes, made by Spark and of 16 MB at most.

    It only saves moving rows that a later exact join would drop: beyond its size it lets more through, never fewer.
    """

    HASHES = 4

    def __init__(self, df: DataFrame, column: str):
        count = df.count()
        self.bits = min(BLOOM_MOST_BITS, max(1 << 12, 1 << int(16 * count).bit_length()))
        low, step = F.col(column).bitwiseAND(F.lit(self.bits - 1)), F.shiftrightunsigned(F.col(column), 32).bitwiseOR(F.lit(1))
        at = F.array(*[(low + step * i).bitwiseAND(F.lit(self.bits - 1)) for i in range(self.HASHES)])
        words = df.select(F.explode(at).alias("at")).groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("v")).toArrow()
        table = np.zeros(self.bits // 32, dtype=np.uint32)
        table[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.uint32)
        self.held = df.sparkSession.sparkContext.broadcast(table)

    def unpersist(self) -> None:
        """Executors may forget the table; it is sent again to those that ask."""
        self.held.unpersist()

    def test(self):
        """A function for executors: int64 hashes -> mask of those that may be in."""
        held, bits, hashes = self.held, self.bits, self.HASHES

        def may(h: np.ndarray) -> np.ndarray:
            table, h = held.value, h.view(np.uint64)
            step, out = (h >> np.uint64(32)) | np.uint64(1), np.ones(len(h), dtype=bool)
            for i in range(hashes):
                at = (h + step * np.uint64(i)) & np.uint64(bits - 1)
                out &= (table[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
            return out

        return may
