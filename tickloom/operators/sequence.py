"""Computations over the order of records. Windows are keyed, by profile and process, so a profile set is spread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.aggregates import P


def attributed(statements: DataFrame, key: str, order: list[str], clock: str) -> DataFrame:
    """statements with elapsed: the time until the next statement of the same key belongs to the earlier one."""
    w = Window.partitionBy(key).orderBy(*order)
    return statements.withColumn("elapsed", F.lead(clock).over(w) - F.col(clock))


def gaps(events: DataFrame, key: str = P, seq: str = "seq") -> DataFrame:
    """key, seq, expected: records that don't follow the one before them by exactly one."""
    w = Window.partitionBy(key).orderBy(seq)
    return events.select(key, seq, (F.lag(seq).over(w) + 1).alias("expected")).where(F.col("expected").isNotNull() & (F.col(seq) != F.col("expected")))


def renumbered(events: DataFrame, order: list[str], key: str = P, seq: str = "seq") -> DataFrame:
    """seq from 0 in the given order, for each key."""
    return events.withColumn(seq, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def numbered(events: DataFrame, key: list[str], seq: str, ties: list[str], width: int = 65_536) -> DataFrame:
    """seq from 0 over all rows, in order of key, old seq and ties.

    Ranges of width of the old seq are numbered each by itself and moved by the rows of the ranges before them, so no
    task holds more than a range; only the number of rows of each range, a row for each, meets in one place. Null
    numbers come first.
    """
    at = F.floor(F.col(seq) / width).cast("long")
    counts = events.select(*key, at.alias("n_range")).groupBy(*key, "n_range").agg(F.count("*").alias("n_rows"))
    before = Window.orderBy(*key, "n_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(k).alias(f"n_{k}") for k in key]
    moved = counts.select(*names, "n_range", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("n_before"))
    own = F.row_number().over(Window.partitionBy(*key, "n_at").orderBy(seq, *ties)) - 1
    rows = events.withColumn("n_at", at).withColumn("n_own", own)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in key], F.col("n_at").eqNullSafe(F.col("n_range")))
    return rows.join(moved, same).withColumn(seq, F.col("n_own") + F.col("n_before")).select(events.columns)


def runs(events: DataFrame, site: list[str], order: list[str], key: str) -> DataFrame:
    """Runs of consecutive records at the same site: key, site, first, last (positions), length."""
    whole = Window.partitionBy(key).orderBy(*order)
    same = Window.partitionBy(key, *site).orderBy(*order)
    at = events.select(key, *site, (F.row_number().over(whole) - 1).alias("pos"), F.row_number().over(same).alias("k"))
    return at.groupBy(key, *site, (F.col("pos") - F.col("k")).alias("island")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("length")).drop("island")


def expanded(runs_: DataFrame, ticks: str = "ticks", base: str = "seq") -> DataFrame:
    """A record for each of a run's ticks (an array), numbered on from the run's base."""
    return runs_.select("*", F.posexplode(ticks).alias("pos", "tick")).withColumn(base, F.col(base) + F.col("pos")).drop(ticks, "pos").withColumnRenamed("tick", ticks)


def exclusive(calls: DataFrame, key: str = P) -> DataFrame:
    """excl of calls (key, enter, exit, depth, overhead): inclusive less the inclusive of calls one deeper within it and
    less overhead, 0 at least.

    Calls of one depth don't overlap, so a call's parent is the last one before it that is one less deep: a running
    maximum over the calls of both depths, one window a depth, instead of a join by range.
    """
    timed = calls.withColumn("incl", F.col("exit") - F.col("enter"))
    sides = timed.select(key, F.col("depth").alias("level"), "enter", F.lit(0).alias("child"), F.lit(0).cast("long").alias("part"), F.col("enter").alias("own"))
    sides = sides.union(timed.select(key, (F.col("depth") - 1).alias("level"), "enter", F.lit(1), F.col("incl").cast("long"), F.lit(None).cast("long")))
    w = Window.partitionBy(key, "level").orderBy("enter", "child").rowsBetween(Window.unboundedPreceding, 0)
    sums = sides.withColumn("parent", F.last("own", ignorenulls=True).over(w)).groupBy(F.col(key).alias("s_key"), F.col("level").alias("s_level"), F.col("parent").alias("s_enter")).agg(F.sum("part").alias("children"))
    out = timed.join(sums, (F.col(key) == F.col("s_key")) & (F.col("depth") == F.col("s_level")) & (F.col("enter") == F.col("s_enter")), "left")
    return out.select(*calls.columns, "incl", F.greatest(F.lit(0), F.col("incl") - F.coalesce("children", F.lit(0)) - F.coalesce("overhead", F.lit(0))).alias("excl"))
