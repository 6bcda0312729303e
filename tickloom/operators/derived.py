"""Report relations: rankings, rollups, heat classes, annotations, choice of the primary file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom.operators import aggregates as agg
from tickloom.operators.aggregates import P
from tickloom.views import Profile


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n of each profile with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(P).orderBy(*order))).where(F.col("rank") <= n)


def top_lines(p: Profile, n: int = 10) -> DataFrame:
    """By calls, then file and line; with the file's base name, or `?`. Only the ranked rows are joined to files."""
    top = _top(agg.line_totals(p), n, F.desc("calls"), "fid", "line")
    names = agg.last(p["NEW_FID"], ["fid"], ["name"])
    return top.join(names, [P, "fid"], "left").select(P, "rank", "fid", "line", "calls", "ticks", F.coalesce(fn.basename("name"), F.lit("?")).alias("file"))


def exclusive_ranking(returns: DataFrame, n: int | None = None) -> DataFrame:
    """Subs by exclusive time, then name."""
    out = agg.sub_totals(returns)
    if n is not None:
        return _top(out, n, F.desc("excl"), "name")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(P).orderBy(F.desc("excl"), "name")))


def edge_ranking(callers: DataFrame) -> DataFrame:
    """Edges by calls, then caller and called."""
    return agg.call_edges(callers).withColumn("rank", F.row_number().over(Window.partitionBy(P).orderBy(F.desc("calls"), "caller", "called")))


def quartiles(df: DataFrame, value: str, table: str) -> DataFrame:
    """profile_id, table, q1, q2, q3, spread, by linear interpolation over the finite values."""
    v = F.col(value).cast("double")
    return df.where(~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).groupBy(P).agg(F.percentile(v, F.lit([0.25, 0.5, 0.75])).alias("q"), (F.max(v) > F.min(v)).alias("spread")).select(P, F.lit(table).alias("table"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "spread")


def display_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mad: the median absolute deviation of value about its median, for each key; nulls are left out.

    Two aggregates by the same keys, so both share one shuffle's partitioning; no group is gathered in an array.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("v"))
    middle = v.groupBy(*keys).agg(F.median("v").alias("m")).select(*[F.col(k).alias(f"m_{k}") for k in keys], "m")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys])
    return v.join(middle, same).groupBy(*keys).agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))


def scales(df: DataFrame, by: list[str] | None = None, **values: Column) -> DataFrame:
    """by (profile_id unless given) and, for each name, its quartiles {name}_q (an array of three) and {name}_spread, all
    by one aggregate. What is null or not finite doesn't count."""
    columns = []
    for name, v in values.items():
        v = v.cast("double")
        v = F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
        columns += [F.percentile(v, F.lit([0.25, 0.5, 0.75])).alias(f"{name}_q"), (F.max(v) > F.min(v)).alias(f"{name}_spread")]
    return df.groupBy(*(by or [P])).agg(*columns)


def _heated(df: DataFrame, scale: DataFrame, **shown: tuple[str, str]) -> DataFrame:
    """df with a class for each alias=(value shown, name of its scale); the scales are joined once."""
    keys = [c for c in scale.columns if c in df.columns]
    q = scale.withColumnsRenamed({k: f"q_{k}" for k in keys})
    out = df.join(q, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"q_{k}") for k in keys]), "left")
    for alias, (value, name) in shown.items():
        cuts = [F.col(f"{name}_q")[i] for i in range(3)]
        out = out.withColumn(alias, fn.heat(value, *cuts, F.coalesce(F.col(f"{name}_spread"), F.lit(False))))
    return out.drop(*q.columns)


def with_heat(df: DataFrame, value: str, alias: str = "heat") -> DataFrame:
    """df with the class of value among the values of its profile."""
    return _heated(df, scales(df, t=F.col(value)), **{alias: (value, "t")})


def sub_heat(returns: DataFrame) -> DataFrame:
    """Subs with heat of exclusive time, and of inclusive time on the exclusive scale."""
    subs = agg.sub_totals(returns)
    return _heated(subs, scales(subs, t=F.col("excl")), excl_heat=("excl", "t"), incl_heat=("incl", "t"))


def line_heat(p: Profile, per_file: bool = False) -> DataFrame:
    """Lines with heat of positive ticks and, on a scale of its own, of positive calls; per_file: within each file."""
    lines = agg.line_totals(p)
    positive = scales(lines, [P, "fid"] if per_file else [P], t=F.when(F.col("ticks") > 0, F.col("ticks")), c=F.when(F.col("calls") > 0, F.col("calls")))
    return _heated(lines, positive, ticks_heat=("ticks", "t"), calls_heat=("calls", "c"))


def index_totals(p: Profile, returns: DataFrame) -> DataFrame:
    """A row for each profile: statements, ticks, sub_calls, files, active (seconds), wall."""
    a = agg.attributes(p).groupBy(P).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("ticks_per_sec", "profiler_active", "profiler_duration", "duration")])
    t = agg.timings(p).groupBy(P).agg(F.count("*").alias("statements"), fn.saturating_sum("ticks").alias("ticks"))
    s = returns.groupBy(P).agg(F.count("*").alias("sub_calls"))
    f = p["NEW_FID"].groupBy(P).agg(F.count_distinct("fid").alias("files"))
    out = a.join(t, P, "full").join(s, P, "full").join(f, P, "full").fillna(0, ["statements", "ticks", "sub_calls", "files"])
    active = F.coalesce(fn.finite("profiler_active"), F.col("ticks") / fn.ticks_per_second("ticks_per_sec"))
    return out.select(P, "statements", "ticks", "sub_calls", "files", active.alias("active"), F.coalesce(fn.finite("profiler_duration"), fn.finite("duration")).alias("wall"))


def run_label(p: Profile) -> DataFrame:
    """profile_id, label: the application, else when it was run, else the profile's own name."""
    a = agg.attributes(p).groupBy(P).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("application", "basetime")])
    return a.select(P, F.coalesce(F.nullif("application", F.lit("")), F.nullif("basetime", F.lit("")), P).alias("label"))


def places_and_files(callers: DataFrame, defs: DataFrame) -> DataFrame:
    """profile_id, called: places (distinct callers, of uncalled edges too) and files (of the callers' definitions, 1 at
    least)."""
    edges = callers.select(P, "caller", "called").distinct()
    at = defs.select(P, F.col("name").alias("caller"), F.col("fid").alias("d_fid"))
    return edges.join(at, [P, "caller"], "left").groupBy(P, "called").agg(F.count("*").alias("places"), F.greatest(F.lit(1), F.count_distinct("d_fid")).alias("files"))


def usable_sites(callers: DataFrame, defs: DataFrame) -> DataFrame:
    """Call sites with a place; the one at (1, 1) only if its caller is defined there."""
    sites = agg.call_sites(callers.where("fid <> 0 AND line <> 0"))
    one = defs.where("fid = 1 AND first_line = 1").select(P, F.col("name").alias("caller"), F.lit(True).alias("at_one"))
    return sites.join(one, [P, "caller"], "left").where("NOT (fid = 1 AND line = 1) OR at_one").drop("at_one")


def calls_from_lines(callers: DataFrame, defs: DataFrame) -> DataFrame:
    """profile_id, fid, line, called: calls and incl of what a line calls, a row for each sub that it calls."""
    return usable_sites(callers, defs).groupBy(P, "fid", "line", "called").agg(F.sum("calls").alias("calls"), F.sum("incl").alias("incl"))


def calls_into_lines(callers: DataFrame, defs: DataFrame) -> DataFrame:
    """profile_id, fid, line (where the called sub begins), called, caller, from_fid, from_line: calls, a row for each
    site, so that a sub that is called from everywhere is never one row or one task."""
    at = defs.where("first_line > 0").select(P, F.col("name").alias("called"), F.col("fid").alias("d_fid"), "first_line")
    into = usable_sites(callers, defs).join(at, [P, "called"])
    return into.select(P, F.col("d_fid").alias("fid"), F.col("first_line").alias("line"), "called", "caller", F.col("fid").alias("from_fid"), F.col("line").alias("from_line"), "calls")


def eligible_files(p: Profile) -> DataFrame:
    """Declared files with source text or timings: a semi-join against the three sets of ids."""
    have = p["SRC_LINE"].select(P, "fid").union(p["TIME_LINE"].select(P, "fid")).union(p["TIME_BLOCK"].select(P, "fid")).distinct()
    return p["NEW_FID"].select(P, "fid").distinct().join(have, [P, "fid"], "left_semi")


def primary_file(p: Profile) -> DataFrame:
    """profile_id, fid: by the first rule that names a file: the application's own; the script (not a library's) with
    most ticks; a name with `workload`; one with source; any eligible one; 1. Ties go to the lowest id."""
    names = agg.files(p).select(P, "fid", "name")
    app = agg.attributes(p).where("key = 'application' AND value <> ''").select(P, F.col("value").alias("app"))
    ticks = agg.file_totals(p).select(P, "fid", "ticks")
    src = p["SRC_LINE"].select(P, "fid").distinct().withColumn("has_source", F.lit(True))
    eligible = eligible_files(p).withColumn("eligible", F.lit(True))
    all_ = names.join(app, P, "left").join(ticks, [P, "fid"], "left").join(src, [P, "fid"], "full").join(eligible, [P, "fid"], "left")
    base = fn.basename("name")
    own = (base == F.col("app")) | (F.col("name") == F.col("app")) | (base == fn.basename("app"))
    rule = (
        F.when(own, 1).when(base.endswith(".pl") & ~fn.is_library("name"), 2).when(F.col("name").contains("workload"), 3).when(F.col("has_source"), 4).when(F.col("eligible"), 5)
    )
    ranked = all_.withColumn("rule", rule).where("rule IS NOT NULL").withColumn("t", F.when(F.col("rule") == 2, F.coalesce("ticks", F.lit(0))).otherwise(F.lit(0)))
    best = ranked.groupBy(P).agg(F.min(F.struct("rule", (-F.col("t")).alias("t"), "fid")).alias("b"))
    every = p["NEW_FID"].select(P).union(p["TIME_LINE"].select(P)).union(p["TIME_BLOCK"].select(P)).distinct()
    return every.join(best, P, "left").select(P, F.coalesce("b.fid", F.lit(1)).alias("fid"), F.coalesce("b.rule", F.lit(6)).alias("rule"))


def source_page(p: Profile) -> DataFrame:
    """profile_id, fid, line: text, calls, ticks, block_calls, block_ticks; a line is there if any of them is."""
    blocks = agg.block_totals(p).select(P, "fid", F.col("block_line").alias("line"), F.col("calls").alias("block_calls"), F.col("ticks").alias("block_ticks"))
    out = agg.source_lines(p).join(agg.line_totals(p), [P, "fid", "line"], "full").join(blocks, [P, "fid", "line"], "full")
    return out.withColumn("text", F.regexp_replace("text", r"[\r\n]+\z", ""))


def core_names(callers: DataFrame) -> DataFrame:
    """profile_id, name: built-in operations at either end of an edge."""
    return callers.select(P, F.explode(F.array("caller", "called")).alias("name")).where(F.col("name").contains("CORE:")).distinct()


def undefined_calls(callers: DataFrame, defs: DataFrame, name_part: str = "CORE:") -> DataFrame:
    """profile_id, called: sites, calls of usable sites to subs with name_part and no definition."""
    sites = usable_sites(callers.where(F.col("called").contains(name_part)), defs)
    return sites.join(defs.select(P, F.col("name").alias("called")), [P, "called"], "left_anti").groupBy(P, "called").agg(F.count("*").alias("sites"), F.sum("calls").alias("calls"))


def subs_of_file(callers: DataFrame, returns: DataFrame, defs: DataFrame, primary: DataFrame) -> DataFrame:
    """profile_id, fid, name: subs shown with a file: defined there, or built-in and of an edge that touches the file or
    on the primary file."""
    names = returns.select(P, "name").distinct()
    own = names.join(defs.select(P, "name", "fid"), [P, "name"])
    core = names.where(F.col("name").contains("CORE:"))
    ends = callers.select(P, "caller", "called").distinct()
    at = defs.select(P, F.col("name").alias("end"), F.col("fid").alias("e_fid"))
    touched = None
    for name, other in (("caller", "called"), ("called", "caller"), ("caller", "caller"), ("called", "called")):
        one = ends.select(P, F.col(name).alias("name"), F.col(other).alias("end")).join(at, [P, "end"]).select(P, F.col("e_fid").alias("fid"), "name")
        touched = one if touched is None else touched.union(one)
    touched = touched.join(core, [P, "name"], "left_semi").select(P, "fid", "name")
    main = core.join(primary.select(P, "fid"), P).select(P, "fid", "name")
    return own.select(P, "fid", "name").union(touched).union(main).distinct()


def definition_coverage(returns: DataFrame, defs: DataFrame) -> DataFrame:
    """profile_id, name, returns, defined."""
    return agg.returns_by_name(returns).join(defs.select(P, "name", F.lit(True).alias("d")), [P, "name"], "left").select(P, "name", "returns", F.coalesce("d", F.lit(False)).alias("defined"))
