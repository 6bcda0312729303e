"""Order of records, and scalar functions over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom.operators import derived, sequence
from tickloom.operators.aggregates import P
from tickloom.plans.registry import query, sql
from tickloom.sources.projections import profile


def _stream(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    seconds = F.expr("unix_date(cast(ts AS date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))").cast("long")
    return e.select("event_id", "user_id", "event_type", seconds.alias("clock"), "ts")


@query("attributed_elapsed", "SELECT event_id, user_id, coalesce(lead(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) - c, -1) AS elapsed FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS c FROM events)")
def attributed_elapsed(spark, d):
    out = sequence.attributed(_stream(spark, d), "user_id", ["ts", "event_id"], "clock")
    return out.select("event_id", "user_id", F.coalesce("elapsed", F.lit(-1)).alias("elapsed"))


@query("sequence_gaps", "SELECT user_id, event_id, prev + 1 AS expected FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL AND event_id <> prev + 1")
def sequence_gaps(spark, d):
    return sequence.gaps(_stream(spark, d), "user_id", "event_id")


@query("renumbered", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def renumbered(spark, d):
    return sequence.renumbered(_stream(spark, d), ["ts", "event_id"], "user_id").select("event_id", "user_id", "seq")


@query("site_runs", "WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, min(pos) AS first, max(pos) AS last, count(*) AS length FROM s GROUP BY user_id, event_type, pos - k")
def site_runs(spark, d):
    return sequence.runs(_stream(spark, d), ["event_type"], ["ts", "event_id"], "user_id")


@query("expanded_runs", "SELECT user_id, event_type, first + i AS seq, (first + i) * 10 AS ticks FROM (WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, min(pos) AS first, unnest(generate_series(0, count(*) - 1)) AS i FROM s GROUP BY user_id, event_type, pos - k)")
def expanded_runs(spark, d):
    runs = sequence.runs(_stream(spark, d), ["event_type"], ["ts", "event_id"], "user_id").select("user_id", "event_type", F.col("first").cast("long").alias("seq"), F.transform(F.sequence("first", "last"), lambda i: (i * 10).cast("long")).alias("ticks"))
    return sequence.expanded(runs)


@query("exclusive_times", "WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) SELECT k AS order_key, i AS depth, 2 * (m - i) + 1 AS incl, CASE WHEN i = m THEN 1 ELSE 2 END AS excl FROM c")
def exclusive_times(spark, d):
    """Each order's lines as calls that nest: line i runs from i to 2m + 1 - i, m lines in all."""
    from pyspark.sql import Window

    item = spark.read.parquet(f"{d}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey")
    c = item.select("l_orderkey", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("depth"), F.count("*").over(w).alias("m"))
    calls = c.select(F.col("l_orderkey").alias("order_key"), "depth", F.col("depth").alias("enter"), (2 * F.col("m") + 1 - F.col("depth")).alias("exit"), F.lit(0).alias("overhead"))
    return sequence.exclusive(calls, "order_key").select("order_key", "depth", "incl", F.col("excl").cast("long").alias("excl"))


@query("package_names", sql("sub_callers", "SELECT DISTINCT called, regexp_extract(called, '^(.+)::', 1) AS package, regexp_replace(called, '[^A-Za-z0-9]', '_', 'g') AS fragment, caller || ' -> ' || called AS edge FROM sub_callers"))
def package_names(spark, d):
    c = profile(spark, d)["SUB_CALLERS"].select(P, "caller", "called").distinct()
    return c.select("called", fn.package_of("called").alias("package"), fn.fragment_id("called").alias("fragment"), fn.edge_key("caller", "called").alias("edge"))


@query("compact_times", "SELECT o_orderkey, CASE WHEN s = 0 THEN '0s' WHEN s < 1e-6 THEN printf('%.0fns', s * 1e9) WHEN s < 1e-3 THEN printf('%.0fµs', s * 1e6) WHEN s < 1 THEN printf(CASE WHEN s * 1e3 >= 100 THEN '%.0fms' WHEN s * 1e3 >= 10 THEN '%.1fms' ELSE '%.2fms' END, s * 1e3) WHEN s < 100 THEN printf(CASE WHEN s >= 10 THEN '%.1fs' ELSE '%.2fs' END, s) ELSE printf('%.0fs', s) END AS shown FROM (SELECT o_orderkey, (o_orderkey % 7919 * 2 + 1) * CASE o_orderkey % 4 WHEN 0 THEN 0.0000001220703125 WHEN 1 THEN 0.0001220703125 WHEN 2 THEN 0.00048828125 ELSE 0.03125 END AS s FROM orders)")
def compact_times(spark, d):
    """Odd multiples of small powers of two, so that no value lies halfway between two printed ones."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    step = F.when(F.col("o_orderkey") % 4 == 0, 0.0000001220703125).when(F.col("o_orderkey") % 4 == 1, 0.0001220703125).when(F.col("o_orderkey") % 4 == 2, 0.00048828125).otherwise(0.03125)
    return o.select("o_orderkey", fn.compact_seconds((F.col("o_orderkey") % 7919 * 2 + 1) * step).alias("shown"))


@query("callgrind_costs", "SELECT o_orderkey, CASE WHEN v >= 0 AND v = floor(v) THEN CAST(v AS BIGINT) WHEN f > 0 THEN f WHEN v > 0 THEN CAST(floor(v + 0.5) AS BIGINT) ELSE 0 END AS cost FROM (SELECT o_orderkey, CAST((o_orderkey % 9 - 4) AS DOUBLE) / 2 AS v, o_orderkey % 3 AS f FROM orders)")
def callgrind_costs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", fn.callgrind_cost((F.col("o_orderkey") % 9 - 4).cast("double") / 2, F.col("o_orderkey") % 3).alias("cost"))


@query("unsigned_ticks", "SELECT o_orderkey, CASE WHEN t < 0 THEN t + 4294967296 ELSE t END AS ticks FROM (SELECT o_orderkey, o_orderkey % 1000 - 500 AS t FROM orders)")
def unsigned_ticks(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", fn.unsigned_ticks(F.col("o_orderkey") % 1000 - 500).alias("ticks"))


@query("saturated_sums", "SELECT o_custkey AS k, CASE WHEN s > 9223372036854775807 THEN 9223372036854775807 WHEN s < -9223372036854775808 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(s AS BIGINT) END AS total FROM (SELECT o_custkey, sum(CAST(CASE WHEN o_custkey % 2 = 0 THEN 4611686018427387904 ELSE -4611686018427387905 END AS HUGEINT)) AS s FROM orders GROUP BY 1)")
def saturated_sums(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    v = F.when(F.col("o_custkey") % 2 == 0, F.lit(4611686018427387904)).otherwise(F.lit(-4611686018427387905))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(fn.saturating_sum(v).alias("total"))


@query("library_paths", "SELECT s_suppkey, regexp_matches(lower(regexp_extract(p, '([^/\\\\]*)$', 1)), '^(config_heavy\\.pl|config\\.pm|sitecustomize\\.pl|warnings\\.pm)$') OR regexp_matches(replace(p, '\\', '/'), '/lib/perl|/lib64/perl|site_perl|vendor_perl|/usr/share/perl|/usr/lib/perl|/usr/lib64/perl') AS library, regexp_extract(p, '([^/\\\\]*)$', 1) AS base FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '/usr/lib64/perl5/' WHEN 1 THEN 'C:\\x\\site_perl\\' WHEN 2 THEN '/app/' ELSE '' END || CASE s_suppkey % 3 WHEN 0 THEN 'Config.pm' ELSE s_name END AS p FROM supplier)")
def library_paths(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    head = F.when(F.col("s_suppkey") % 4 == 0, "/usr/lib64/perl5/").when(F.col("s_suppkey") % 4 == 1, "C:\\x\\site_perl\\").when(F.col("s_suppkey") % 4 == 2, "/app/").otherwise("")
    p = F.concat(head, F.when(F.col("s_suppkey") % 3 == 0, F.lit("Config.pm")).otherwise(F.col("s_name")))
    return s.select("s_suppkey", fn.is_library(p).alias("library"), fn.basename(p).alias("base"))


@query("display_mad", "WITH g AS (SELECT l_suppkey AS k, l_quantity AS v FROM lineitem), m AS (SELECT k, median(v) AS m FROM g GROUP BY 1) SELECT k, median(abs(v - m)) AS mad FROM g JOIN m USING (k) GROUP BY 1")
def display_mad(spark, d):
    item = spark.read.parquet(f"{d}/lineitem.parquet")
    return derived.display_mad(item.select(F.col("l_suppkey").alias("k"), "l_quantity"), ["k"], "l_quantity")
