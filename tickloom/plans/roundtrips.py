"""What sources and encoders give back: the projected profile is written in each form, read again, and summed up by tag."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import aggregates as agg
from tickloom.operators import derived, tools
from tickloom.operators.aggregates import P
from tickloom.plans.core import halves
from tickloom.plans.registry import VIEWS, query, sql
from tickloom.sinks import text
from tickloom.sources import binary, jsonl, wire_v6
from tickloom.sources.projections import profile
from tickloom.staging import workspace
from tickloom.views import Profile

#: view -> what is summed of its integers, its times, and the lengths of its texts.
_SUMS = {
    "time_line": ("ticks + fid + line", "0", "0"),
    "time_block": ("ticks + fid + line + block_line", "0", "0"),
    "discount": ("0", "0", "0"),
    "sub_entry": ("fid + line", "0", "0"),
    "sub_return": ("depth", "incl + excl", "length(name)"),
    "sub_callers": ("fid + line + calls + depth", "incl + excl + reci", "length(called) + length(caller)"),
    "new_fid": ("fid", "0", "length(name)"),
    "sub_info": ("fid + first_line + last_line", "0", "length(name)"),
    "src_line": ("fid + line", "0", "length(text)"),
    "attribute": ("0", "0", "length(key) + length(value)"),
    "option": ("0", "0", "length(key) + length(value)"),
    "pid_start": ("pid", "time", "0"),
    "pid_end": ("pid", "time", "0"),
}
_DIGEST = sql(" ".join(_SUMS), " UNION ALL ".join(f"SELECT '{v.upper()}' AS tag, count(*) AS events, CAST(sum({n}) AS BIGINT) AS numbers, CAST(sum({t}) AS BIGINT) AS times, CAST(sum({c}) AS BIGINT) AS chars FROM {v}" for v, (n, t, c) in _SUMS.items()))


def _digest(events):
    """tag: events, numbers, times, chars of the tags that the tables have."""
    total = lambda kind, f: sum((F.coalesce(f(c), F.lit(0)) for c, k in schemas.COLUMNS.items() if k in kind and c not in ("sub_line", "ppid", "eval_fid", "eval_line", "flags", "size", "mtime")), F.lit(0))
    rows = events.where(F.col("tag").isin([v.upper() for v in _SUMS])).groupBy("tag")
    return rows.agg(F.count("*").alias("events"), F.sum(total("ui", F.col)).cast("long").alias("numbers"), F.sum(total("n", F.col)).cast("long").alias("times"), F.sum(total("s", F.length)).cast("long").alias("chars"))


def _events(spark, d):
    """The profile as 64 of them, by seq, so that as many tasks can encode it; seq begins with 0, as a dump's has to."""
    e = profile(spark, d).events().withColumn(P, F.concat(F.lit("p"), F.pmod("seq", F.lit(64)).cast("string")))
    return e.withColumn("seq", F.col("seq") + 1)


def _through(events, wire, **options):
    folder = workspace(events.sparkSession, f"profiles-{wire}")
    binary.write(events, folder, wire, **options)
    return _digest(binary.read(events.sparkSession, folder, mixed=True))


@query("jsonl_roundtrip", _DIGEST)
def jsonl_roundtrip(spark, d):
    folder = workspace(spark, "dumps")
    jsonl.write(_events(spark, d), folder)
    return _digest(jsonl.read(spark, f"{folder}/*"))


@query("v5_roundtrip", _DIGEST)
def v5_roundtrip(spark, d):
    return _through(_events(spark, d), "v5")


@query("v6_roundtrip", _DIGEST)
def v6_roundtrip(spark, d):
    return _through(tools.lossy(_events(spark, d)), "v6")


@query("v6_packed_roundtrip", _DIGEST)
def v6_packed_roundtrip(spark, d):
    """Site differences, sequence numbers, runs, a string dictionary, zstd, chunks that end within records."""
    return _through(tools.lossy(_events(spark, d)), "v6", packed=True, runs=True, strings=True, codec=wire_v6.ZSTD, split_bytes=4000)


@query("v6_mixed_roundtrip", _DIGEST)
def v6_mixed_roundtrip(spark, d):
    """With records of other kinds beside the events, a codec for each kind."""
    side = {"source": [[1, 2, "text"]], "index": [[1, 2, 3, "k"]], "summary": [[4, 5, 6, "z"]]}
    return _through(tools.lossy(_events(spark, d)), "v6", side=side, codec=wire_v6.LZ4, codecs={wire_v6.SOURCE: wire_v6.ZLIB, wire_v6.INDEX: wire_v6.ZSTD})


_BY_KEY = " UNION ALL ".join(
    f"SELECT (({k}) % 64 + 64) % 64 AS k, {n} AS n FROM {t} GROUP BY 1"
    for t, k, n in (
        ("lineitem", "l_orderkey", "2 * count(*) + count(*) FILTER (l_discount = 0)"), ("events", "event_id", "count(*) + count(*) FILTER (event_type = 'click')"), ("supplier", "s_suppkey", "count(*)"), ("part", "p_partkey", "2 * count(*)"),
        ("region", "r_regionkey", "count(*)"), ("nation", "n_nationkey", "count(*)"), ("orders", "o_orderkey", "count(*) + count(*) FILTER (o_orderstatus = 'F')"), ("(SELECT -1 AS minus)", "minus", "count(*)"),
    )
)


@query("salvage_prefix", f"SELECT 'p' || k AS profile_id, CAST((sum(n) - 1) // 100 * 100 + 1 AS BIGINT) AS records FROM ({_BY_KEY}) GROUP BY k")
def salvage_prefix(spark, d):
    """Each file is cut within its last chunk of 100 records: all chunks before come back, and the header's version."""
    folder = workspace(spark, "profiles-cut")
    files = binary.write(tools.lossy(_events(spark, d)), folder, "v6", cut=wire_v6.FRAME.size + 1, per_chunk=100, codec=wire_v6.NONE)
    return binary.salvaged_files(files).select(P, "records")


@query("edges_csv", sql("edges", "SELECT caller || ',' || called || ',' || calls || ',' || CAST(incl AS BIGINT) || ',' || CAST(excl AS BIGINT) AS line FROM edges"))
def edges_csv(spark, d):
    return text.edge_rows(profile(spark, d)).select("line")


_FIRST = "SELECT * FROM new_fid WHERE fid = 3"


@query(
    "aggregates_json",
    sql(
        "time_line time_block discount sub_entry sub_return sub_callers new_fid sub_info src_line pid_start pid_end lines blocks attribute",
        " UNION ALL ".join(
            [f"SELECT '{v}_events' AS key, CAST(count(*) AS VARCHAR) AS value FROM {v}" for v in "discount sub_entry time_line time_block pid_start pid_end sub_return new_fid sub_callers src_line sub_info".split()]
            + [
                "SELECT 'is_stream_complete', CASE WHEN (SELECT count(*) FROM pid_start) <= (SELECT count(*) FROM pid_end) THEN 'true' ELSE 'false' END",
                "SELECT 'line_calls_3_2', CAST(calls AS VARCHAR) FROM lines WHERE fid = 3 AND line = 2",
                "SELECT 'block_line_calls_3_1', CAST(calls AS VARCHAR) FROM blocks WHERE fid = 3 AND block_line = 1",
                "SELECT 'attribute_ticks_per_sec', '\"10000000\"'",
                f"SELECT 'file_3', '\"' || name || '\"' FROM ({_FIRST})",
                f"SELECT 'file_3_basename', '\"' || regexp_extract(name, '([^/]*)$', 1) || '\"' FROM ({_FIRST})",
                "SELECT 'subs', CAST(count(DISTINCT name) AS VARCHAR) FROM sub_return",
                "SELECT 'edges', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT caller, called FROM sub_callers)",
                "SELECT 'leaf_returns', CAST(count(*) AS VARCHAR) FROM sub_return WHERE name = 'main::click'",
            ]
        ),
    ),
)
def aggregates_json(spark, d):
    """The report's object, a row for each key; of subs and edges, how many there are."""
    said = json.loads(text.aggregates_json(profile(spark, d), "p", leaf="main::click", line=(3, 2), block=(3, 1), fid=3))
    keep = [*(f"{v}_events" for v in "discount sub_entry time_line time_block pid_start pid_end sub_return new_fid sub_callers src_line sub_info".split()), "is_stream_complete", "line_calls_3_2", "block_line_calls_3_1", "attribute_ticks_per_sec", "file_3", "file_3_basename", "leaf_returns"]
    rows = [(k, json.dumps(said[k])) for k in keep] + [(k, str(len(said[k]))) for k in ("subs", "edges")]
    return spark.createDataFrame(rows, "key string, value string")


def _branch(name: str, keys: str, values: list[str], of: str) -> str:
    """SQL of one aggregate's differences: of has side, the keys and the values."""
    k, pair = keys.split(), [f"a.{v} IS DISTINCT FROM b.{v}" for v in values]
    on = " AND ".join(f"a.{x} = b.{x}" for x in k)
    said = lambda s: f"CASE WHEN {s}.{k[0]} IS NOT NULL THEN " + " || '|' || ".join(f"{s}.{v}" for v in values) + " END"
    key = " || '|' || ".join(f"coalesce(a.{x}, b.{x})" for x in k)
    return f"SELECT '{name}' AS aggregate, CAST({key} AS VARCHAR) AS key, CAST({said('a')} AS VARCHAR) AS left, CAST({said('b')} AS VARCHAR) AS right FROM (SELECT * FROM {of} WHERE side = 0) a FULL JOIN (SELECT * FROM {of} WHERE side = 1) b ON {on} WHERE {' OR '.join(pair)}"


_T = "SELECT l_orderkey % 2 AS side, l_suppkey AS fid, l_linenumber AS line, l_linenumber - (l_linenumber - 1) % 3 AS block_line, l_linestatus AS status, l_discount AS discount, CAST(round(l_extendedprice*100) AS BIGINT) AS t, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice*100) AS BIGINT) // 2 AS e, CAST(round(l_tax*100) AS BIGINT) AS r, 'P' || (l_partkey % 10) || '::f' || (l_partkey % 40) AS called, 'P' || (l_suppkey % 10) || '::f' || (l_suppkey % 40) AS caller FROM lineitem"
_COUNTS = " UNION ALL ".join(
    [f"SELECT side, '{tag}' AS tag, count(*) AS events FROM t WHERE {where} GROUP BY 1" for tag, where in (("TIME_LINE", "status = 'O'"), ("TIME_BLOCK", "status = 'F'"), ("DISCOUNT", "discount = 0"), ("SUB_CALLERS", "true"))]
    + ["SELECT o_orderkey % 2, 'PID_START', count(*) FROM orders GROUP BY 1", "SELECT o_orderkey % 2, 'PID_END', count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"]
)


@query(
    "compare_all",
    f"WITH t AS ({_T}), c AS ({_COUNTS}), l AS (SELECT side, fid, line, count(*) AS n, CAST(sum(t) AS BIGINT) AS s FROM t GROUP BY 1, 2, 3), k AS (SELECT side, fid, block_line, count(*) AS n, CAST(sum(t) AS BIGINT) AS s FROM t WHERE status = 'F' GROUP BY 1, 2, 3), "
    "g AS (SELECT side, caller, called, CAST(sum(q) AS BIGINT) AS n, max(line) AS d, CAST(sum(t) AS BIGINT) AS i, CAST(sum(e) AS BIGINT) AS e, CAST(sum(r) AS BIGINT) AS r FROM t GROUP BY 1, 2, 3) "
    + " UNION ALL ".join([_branch("counts", "tag", ["events"], "c"), _branch("lines", "fid line", ["n", "s"], "l"), _branch("blocks", "fid block_line", ["n", "s"], "k"), _branch("edges", "caller called", ["n", "d", "i", "e", "r"], "g")]),
)
def compare_all(spark, d):
    """All ten aggregates; the halves have the same subs, source, definitions, files, attributes and options."""
    return tools.compare(*halves(spark, d))


_CASES = "SELECT s_suppkey % 7 AS c, s_suppkey AS fid, CASE s_suppkey % 7 WHEN 6 THEN '/usr/lib/perl/' ELSE '/app/' END || s_name || CASE WHEN s_suppkey % 7 IN (0, 1, 6) THEN '.pl' WHEN s_suppkey % 7 = 2 THEN '_workload' ELSE '.pm' END AS name FROM supplier"


@query(
    "primary_file_rules",
    f"WITH f AS ({_CASES}), t AS (SELECT l_suppkey AS fid, sum(round(l_extendedprice*100)) AS t FROM lineitem GROUP BY 1), o AS (SELECT c, fid, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN c = 1 THEN -coalesce(t, 0) ELSE 0 END, CASE WHEN c = 0 THEN -fid ELSE fid END) AS n FROM f LEFT JOIN t USING (fid)) "
    "SELECT 'c' || c AS profile_id, CASE WHEN c = 5 THEN 1 ELSE fid END AS fid, CAST(CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 5 END AS INTEGER) AS rule FROM o WHERE n = 1",
)
def primary_file_rules(spark, d):
    """Seven profiles of the suppliers as files, each for one rule: the application's own file (the last), the script
    with most ticks, a name with `workload`, one with source, one with timings, none, and a library's script."""
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("c", F.col("s_suppkey") % 7)
    name = F.concat(F.when(F.col("c") == 6, "/usr/lib/perl/").otherwise("/app/"), "s_name", F.when(F.col("c").isin(0, 1, 6), ".pl").when(F.col("c") == 2, "_workload").otherwise(".pm"))
    files = s.select(F.concat(F.lit("c"), F.col("c").cast("string")).alias(P), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("fid"), name.alias("name"), "c")
    own = files.where("c = 0").groupBy(P).agg(F.max_by("name", "fid").alias("value"))
    item = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("c", F.col("l_suppkey") % 7).where("c IN (1, 4, 6)")
    lines = item.select(F.concat(F.lit("c"), F.col("c").cast("string")).alias(P), F.col("l_orderkey").alias("seq"), F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("ticks"), F.col("l_suppkey").alias("fid"), F.col("l_linenumber").alias("line"))
    source = files.where("c = 3").select(P, "seq", "fid", F.lit(1).alias("line"), F.lit("x").alias("text"))
    made = {"NEW_FID": files.drop("c"), "ATTRIBUTE": own.select(P, F.lit(0).alias("seq"), F.lit("application").alias("key"), "value"), "TIME_LINE": lines, "SRC_LINE": source}
    out = None
    for tag, view in made.items():
        view = view.withColumn("tag", F.lit(tag))
        out = view if out is None else out.unionByName(view, allowMissingColumns=True)
    for f in schemas.EVENTS.fields:
        out = out.withColumn(f.name, (F.col(f.name) if f.name in out.columns else F.lit(0 if f.name in ("eval_fid", "eval_line", "flags", "size", "mtime") else None)).cast(f.dataType))
    return derived.primary_file(Profile.of(out)).select(P, "fid", "rule")


_STARTS = "SELECT 'start' AS kind, place, pid, time FROM (SELECT o_orderkey AS place, o_orderkey AS pid, epoch(o_orderdate) AS time FROM orders) UNION ALL SELECT 'end', place, pid, time FROM (SELECT o_orderkey AS place, o_orderkey AS pid, epoch(o_orderdate) AS time FROM orders WHERE o_orderstatus = 'F')"


@query("pid_records", _STARTS)
def pid_records(spark, d):
    """Every start and end of a process with its place among the records."""
    p = profile(spark, d)
    starts = agg.pid_starts(p).select(F.lit("start").alias("kind"), "place", "pid", F.col("start_time").alias("time"))
    return starts.union(agg.pid_ends(p).select(F.lit("end").alias("kind"), "place", "pid", F.col("end_time").alias("time")))


@query("normalized_times", sql("pid_end", "SELECT pid, CAST(CAST(time AS BIGINT) AS VARCHAR) AS time FROM pid_end"))
def normalized_times(spark, d):
    """Arguments of a dump in their stable text form."""
    rows = tools.normalized_args(profile(spark, d).events()).where("tag = 'PID_END'")
    return rows.select(F.get("args", F.lit(0)).try_cast("long").alias("pid"), F.get("args", F.lit(1)).alias("time"))
