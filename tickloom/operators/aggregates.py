"""The aggregates of a profile, each a partial and final hash aggregate over one view.

All are keyed by profile_id first, so one call serves one profile or millions. Last-write-wins picks by seq.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom import schemas
from tickloom.views import Profile

P = "profile_id"


def _tags(p: Profile, tags: list[str]) -> DataFrame:
    """profile_id, tag of the records with these tags: two columns of one scan where the profile is one relation."""
    if p.relation is not None:
        return p.relation.where(F.col("tag").isin(tags)).select(P, "tag")
    return reduce(DataFrame.unionAll, [p[t].select(P, F.lit(t).alias("tag")) for t in tags])


def tag_counts(p: Profile, tags: list[str] | None = None) -> DataFrame:
    """profile_id, tag, events of these tags, by default of all; tags without events are left out."""
    return _tags(p, tags or list(schemas.TAGS)).groupBy(P, "tag").agg(F.count("*").alias("events"))


def counters(p: Profile, tags: list[str] | None = None) -> DataFrame:
    """A row for each profile: time_line_events, time_block_events, discount_events, the other tags' counts, total_events
    and dump_records, which counts the closing record too. With tags, the counts of those alone, and only they are read."""
    names = {t: f"{t.lower()}_events" for t in tags or schemas.TAGS}
    wide = [F.count_if(F.col("tag") == t).alias(n) for t, n in names.items()]
    if tags is None:
        wide += [F.count("*").alias("total_events"), (F.count("*") + 1).alias("dump_records")]
    return _tags(p, list(names)).groupBy(P).agg(*wide)


def timings(p: Profile) -> DataFrame:
    """Both kinds of timing: profile_id, fid, line, ticks."""
    return p["TIME_LINE"].select(P, "fid", "line", "ticks").unionAll(p["TIME_BLOCK"].select(P, "fid", "line", "ticks"))


def line_totals(p: Profile) -> DataFrame:
    """profile_id, fid, line: calls, ticks over both timing tags."""
    return timings(p).groupBy(P, "fid", "line").agg(F.count("*").alias("calls"), fn.saturating_sum("ticks").alias("ticks"))


def block_totals(p: Profile) -> DataFrame:
    """profile_id, fid, block_line: calls, ticks of blocks."""
    return p["TIME_BLOCK"].groupBy(P, "fid", "block_line").agg(F.count("*").alias("calls"), fn.saturating_sum("ticks").alias("ticks"))


def sub_totals(returns: DataFrame) -> DataFrame:
    """profile_id, name: returns, incl, excl, from a SUB_RETURN view."""
    return returns.groupBy(P, "name").agg(F.count("*").alias("returns"), F.sum("incl").alias("incl"), F.sum("excl").alias("excl"))


def workload_subs(returns: DataFrame) -> DataFrame:
    """Sub totals of the workload's own subs; the filter runs before the aggregate."""
    return sub_totals(returns.where(fn.is_workload("name")))


def call_edges(callers: DataFrame) -> DataFrame:
    """profile_id, caller, called: calls, incl, excl, reci, max_rec_depth, sites (records), from a SUB_CALLERS view."""
    return callers.groupBy(P, "caller", "called").agg(
        fn.saturating_sum("calls").alias("calls"), F.sum("incl").alias("incl"), F.sum("excl").alias("excl"), F.sum("reci").alias("reci"), F.max("depth").alias("max_rec_depth"), F.count("*").alias("sites")
    )


def call_sites(callers: DataFrame, strict_limit: int | None = None) -> DataFrame:
    """profile_id, caller, called, fid, line: calls, incl, excl. Never cut; with strict_limit more sites than that in a
    profile are an error."""
    out = callers.groupBy(P, "caller", "called", "fid", "line").agg(fn.saturating_sum("calls").alias("calls"), F.sum("incl").alias("incl"), F.sum("excl").alias("excl"))
    if strict_limit is not None:
        over = out.groupBy(P).count().where(F.col("count") > strict_limit).first()
        if over:
            raise ValueError(f"{over[P]}: {over['count']} call sites, more than {strict_limit}")
    return out


def last(view: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The values of the record with the highest seq for each key."""
    return view.groupBy(P, *keys).agg(F.max_by(F.struct(*values), "seq").alias("v")).select(P, *keys, *[F.col(f"v.{c}").alias(c) for c in values])


def source_lines(p: Profile) -> DataFrame:
    return last(p["SRC_LINE"], ["fid", "line"], ["text"])


def sub_defs(p: Profile) -> DataFrame:
    return last(p["SUB_INFO"], ["name"], ["fid", "first_line", "last_line"])


def files(p: Profile) -> DataFrame:
    """profile_id, fid, name and the other arguments of the last NEW_FID."""
    return last(p["NEW_FID"], ["fid"], ["name", "eval_fid", "eval_line", "flags", "size", "mtime"])


def attributes(p: Profile) -> DataFrame:
    return last(p["ATTRIBUTE"], ["key"], ["value"])


def options(p: Profile) -> DataFrame:
    return last(p["OPTION"], ["key"], ["value"])


def pids(p: Profile) -> DataFrame:
    """profile_id, pid: each once, for ordering by the caller."""
    return p["PID_START"].select(P, "pid").union(p["PID_END"].select(P, "pid")).distinct()


def pid_starts(p: Profile) -> DataFrame:
    """profile_id, place, pid, ppid, start_time: every start of a process, in order of place, the record's seq."""
    return p["PID_START"].select(P, F.col("seq").alias("place"), "pid", "ppid", F.col("time").alias("start_time"))


def pid_ends(p: Profile) -> DataFrame:
    """profile_id, place, pid, end_time: every end of a process, in order of place."""
    return p["PID_END"].select(P, F.col("seq").alias("place"), "pid", F.col("time").alias("end_time"))


def process_spans(p: Profile) -> DataFrame:
    """profile_id, pid: starts, ends, first start, last end."""
    both = p["PID_START"].select(P, "pid", F.lit(1).alias("s"), F.lit(0).alias("e"), F.col("time").alias("t0"), F.lit(None).cast("double").alias("t1"))
    both = both.union(p["PID_END"].select(P, "pid", F.lit(0), F.lit(1), F.lit(None).cast("double"), "time"))
    return both.groupBy(P, "pid").agg(F.sum("s").alias("starts"), F.sum("e").alias("ends"), F.min("t0").alias("start_time"), F.max("t1").alias("end_time"))


def entry_sites(p: Profile) -> DataFrame:
    """profile_id, fid, line: entries from that caller's place."""
    return p["SUB_ENTRY"].groupBy(P, "fid", "line").agg(F.count("*").alias("entries"))


def returns_by_name(returns: DataFrame) -> DataFrame:
    return returns.groupBy(P, "name").agg(F.count("*").alias("returns"))


def file_totals(p: Profile) -> DataFrame:
    """profile_id, fid: calls, ticks over its lines; from the timings at once."""
    return timings(p).groupBy(P, "fid").agg(F.count("*").alias("calls"), fn.saturating_sum("ticks").alias("ticks"))


def file_totals_with_footer(p: Profile) -> DataFrame:
    """file_totals, and for each profile a row with fid null for all of them."""
    return timings(p).groupBy(P, "fid").agg(F.count("*").alias("c"), fn.saturating_sum("ticks").alias("t")).rollup(P, "fid").agg(F.sum("c").alias("calls"), F.sum("t").alias("ticks")).where(F.col(P).isNotNull())


def package_totals(returns: DataFrame) -> DataFrame:
    """profile_id, package: subs, returns, excl. Subs are counted after they are aggregated, so that names are few."""
    return sub_totals(returns).groupBy(P, fn.package_of("name").alias("package")).agg(F.count("*").alias("subs"), F.sum("returns").alias("returns"), F.sum("excl").alias("excl"))
