"""Aggregates and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom import schemas
from tickloom.operators import aggregates as agg
from tickloom.operators import derived, tools
from tickloom.plans.registry import query, sql
from tickloom.sources import projections as tables
from tickloom.sources.projections import call_returns, profile

P = agg.P


@query("top_lines", sql("lines new_fid", "SELECT rank, fid, line, calls, ticks, coalesce(regexp_extract(name, '([^/]*)$', 1), '?') AS file FROM (SELECT *, row_number() OVER (ORDER BY calls DESC, fid, line) AS rank FROM lines) LEFT JOIN new_fid USING (fid) WHERE rank <= 10"))
def top_lines(spark, d):
    return derived.top_lines(profile(spark, d)).drop(P)


@query("a1_a2_a3_counters", sql("time_line time_block discount sub_entry sub_return", "SELECT (SELECT count(*) FROM time_line) AS time_line_events, (SELECT count(*) FROM time_block) AS time_block_events, (SELECT count(*) FROM discount) AS discount_events, (SELECT count(*) FROM sub_entry) AS sub_entry_events, (SELECT count(*) FROM sub_return) AS sub_return_events"))
def counters(spark, d):
    return agg.counters(profile(spark, d), ["TIME_LINE", "TIME_BLOCK", "DISCOUNT", "SUB_ENTRY", "SUB_RETURN"]).drop(P)


@query("tag_counts", sql("time_line time_block discount sub_entry sub_return sub_callers new_fid sub_info src_line attribute option pid_start pid_end", " UNION ALL ".join(f"SELECT '{t.upper()}' AS tag, count(*) AS events FROM {t}" for t in "time_line time_block discount sub_entry sub_return sub_callers new_fid sub_info src_line attribute option pid_start pid_end".split())))
def tag_counts(spark, d):
    return agg.tag_counts(profile(spark, d)).drop(P)


_TOTAL = "SELECT (SELECT count(*) FROM lineitem) * 2 + (SELECT count(*) FROM lineitem WHERE l_discount = 0) + (SELECT count(*) FROM events WHERE event_type = 'click') + (SELECT count(*) FROM events) + (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM part) + (SELECT count(*) FROM region) + 1 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n"


@query("total_events", f"SELECT CAST(n AS BIGINT) AS total_events, CAST(n + 1 AS BIGINT) AS dump_records FROM ({_TOTAL})")
def total_events(spark, d):
    return agg.counters(profile(spark, d)).select("total_events", "dump_records")


@query("a4_line_totals", sql("lines", "SELECT * FROM lines"))
def line_totals(spark, d):
    return agg.line_totals(profile(spark, d)).drop(P)


@query("a4b_block_totals", sql("blocks", "SELECT * FROM blocks"))
def block_totals(spark, d):
    return agg.block_totals(profile(spark, d)).drop(P)


@query("a5_sub_totals", sql("sub_return", "SELECT name, count(*) AS returns, sum(incl) AS incl, sum(excl) AS excl FROM sub_return GROUP BY 1"))
def sub_totals(spark, d):
    return agg.sub_totals(profile(spark, d)["SUB_RETURN"]).drop(P)


@query("a5_call_totals", sql("subs", "SELECT * FROM subs"))
def call_totals(spark, d):
    return agg.sub_totals(call_returns(spark, d)).drop(P)


@query("a6_workload_subs", sql("call_return", "SELECT replace(replace(name, '::f1', '::leaf'), '::f2', '::mid') AS name, count(*) AS returns, sum(incl) AS incl, sum(excl) AS excl FROM call_return WHERE regexp_matches(replace(replace(name, '::f1', '::leaf'), '::f2', '::mid'), '(::leaf|::mid)$|main::leaf|main::mid') GROUP BY 1"))
def workload(spark, d):
    named = call_returns(spark, d).withColumn("name", F.replace(F.replace("name", F.lit("::f1"), F.lit("::leaf")), F.lit("::f2"), F.lit("::mid")))
    return agg.workload_subs(named).drop(P)


@query("a7_call_edges", sql("edges", "SELECT * FROM edges"))
def call_edges(spark, d):
    return agg.call_edges(profile(spark, d)["SUB_CALLERS"]).drop(P)


@query("a7s_call_sites", sql("sites", "SELECT * FROM sites"))
def call_sites(spark, d):
    return agg.call_sites(profile(spark, d)["SUB_CALLERS"]).drop(P)


@query("a8_source_lines", sql("src_line", "SELECT fid, line, arg_max(text, seq) AS text FROM src_line GROUP BY 1, 2"))
def source_lines(spark, d):
    return agg.source_lines(profile(spark, d)).drop(P)


@query("a8_document_lines", "SELECT doc_id AS fid, CAST(i AS BIGINT) AS line, s[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)")
def document_lines(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    view = lines.select(F.lit("docs").alias(P), F.col("i").cast("long").alias("seq"), F.col("doc_id").alias("fid"), (F.col("i") + 1).cast("long").alias("line"), "text")
    return agg.last(view, ["fid", "line"], ["text"]).drop(P)


@query("a9_sub_defs", sql("defs", "SELECT * FROM defs"))
def sub_defs(spark, d):
    return agg.sub_defs(profile(spark, d)).drop(P)


@query("files", sql("new_fid", "SELECT fid, name, regexp_extract(name, '([^/]*)$', 1) AS basename FROM new_fid"))
def files(spark, d):
    return agg.files(profile(spark, d)).select("fid", "name", fn.basename("name").alias("basename"))


@query("attributes", sql("attribute", "SELECT * FROM attribute"))
def attributes(spark, d):
    return agg.attributes(profile(spark, d)).drop(P)


@query("options", sql("option", "SELECT * FROM option"))
def options(spark, d):
    return agg.options(profile(spark, d)).drop(P)


@query("pids", sql("pid_start pid_end", "SELECT pid FROM pid_start UNION SELECT pid FROM pid_end"))
def pids(spark, d):
    return agg.pids(profile(spark, d)).drop(P)


@query("process_spans", sql("pid_start pid_end", "SELECT pid, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, min(t0) AS start_time, max(t1) AS end_time FROM (SELECT pid, 1 AS s, 0 AS e, time AS t0, NULL AS t1 FROM pid_start UNION ALL SELECT pid, 0, 1, NULL, time FROM pid_end) GROUP BY 1"))
def process_spans(spark, d):
    return agg.process_spans(profile(spark, d)).drop(P)


@query("lifecycle", "SELECT count(*) AS processes, count(*) AS started, count(*) FILTER (o_orderstatus = 'F') AS ended, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders")
def lifecycle(spark, d):
    return tools.lifecycle(profile(spark, d)).drop(P)


@query("sub_entries", sql("sub_entry", "SELECT fid, line, count(*) AS entries FROM sub_entry GROUP BY 1, 2"))
def sub_entries(spark, d):
    return agg.entry_sites(profile(spark, d)).drop(P)


@query("returns_by_name", sql("sub_return", "SELECT name, count(*) AS returns FROM sub_return GROUP BY 1"))
def returns_by_name(spark, d):
    return agg.returns_by_name(profile(spark, d)["SUB_RETURN"]).drop(P)


@query("file_totals", sql("timing", "SELECT fid, count(*) AS calls, CAST(sum(ticks) AS BIGINT) AS ticks FROM timing GROUP BY 1"))
def file_totals(spark, d):
    return agg.file_totals(profile(spark, d)).drop(P)


@query("file_totals_footer", sql("timing", "SELECT coalesce(fid, -1) AS fid, count(*) AS calls, CAST(sum(ticks) AS BIGINT) AS ticks FROM timing GROUP BY GROUPING SETS ((fid), ())"))
def file_totals_footer(spark, d):
    return agg.file_totals_with_footer(profile(spark, d)).select(F.coalesce("fid", F.lit(-1).cast("long")).alias("fid"), "calls", F.col("ticks").cast("long").alias("ticks"))


@query("package_totals", sql("subs", "SELECT regexp_extract(name, '^(.+)::', 1) AS package, count(*) AS subs, CAST(sum(returns) AS BIGINT) AS returns, sum(excl) AS excl FROM subs GROUP BY 1"))
def package_totals(spark, d):
    return agg.package_totals(call_returns(spark, d)).drop(P)


@query("line_lookup", sql("lines", "SELECT fid, line, calls, ticks FROM lines WHERE fid = 3 AND line = 2"))
def line_lookup(spark, d):
    """The filter is on the keys, so it is pushed below the aggregate to the scan."""
    return agg.line_totals(profile(spark, d)).where("fid = 3 AND line = 2").drop(P)


@query("sub_lookup", sql("subs", "SELECT name, coalesce(returns, 0) AS returns FROM (VALUES ('P1::f1'), ('none::such')) v(name) LEFT JOIN subs USING (name)"))
def sub_lookup(spark, d):
    asked = spark.createDataFrame([("P1::f1",), ("none::such",)], "name string")
    return asked.join(agg.returns_by_name(call_returns(spark, d).where(F.col("name").isin("P1::f1", "none::such"))), "name", "left").select("name", F.coalesce("returns", F.lit(0)).alias("returns"))


@query("completeness", sql("pid_start pid_end timing", "SELECT CASE WHEN (SELECT count(*) FROM pid_start) > (SELECT count(*) FROM pid_end) THEN 'missing PID_END after PID_START' ELSE '' END AS reasons, (SELECT count(*) FROM pid_start) <= (SELECT count(*) FROM pid_end) AS complete"))
def completeness(spark, d):
    return tools.completeness(profile(spark, d)).drop(P)


def halves(spark, d):
    """Two profiles: orders and lines of even and of odd order keys."""
    from tickloom.views import Profile

    p = profile(spark, d)
    pick = lambda r: {t: p[t].where(F.col("seq") % 2 == r) if t in ("TIME_LINE", "TIME_BLOCK", "PID_START", "PID_END", "SUB_CALLERS", "DISCOUNT") else p[t] for t in schemas.TAGS}
    return Profile(pick(0)), Profile(pick(1))


@query("compare_profiles", sql("", "WITH t AS (SELECT l_orderkey % 2 AS side, l_suppkey AS fid, l_linenumber AS line, CAST(round(l_extendedprice*100) AS BIGINT) AS ticks FROM lineitem), a AS (SELECT fid, line, count(*) AS c, CAST(sum(ticks) AS BIGINT) AS s FROM t WHERE side = 0 GROUP BY 1, 2), b AS (SELECT fid, line, count(*) AS c, CAST(sum(ticks) AS BIGINT) AS s FROM t WHERE side = 1 GROUP BY 1, 2) SELECT 'lines' AS aggregate, concat_ws('|', coalesce(a.fid, b.fid), coalesce(a.line, b.line)) AS key, CASE WHEN a.c IS NOT NULL THEN a.c || '|' || a.s END AS left, CASE WHEN b.c IS NOT NULL THEN b.c || '|' || b.s END AS right FROM a FULL JOIN b ON a.fid = b.fid AND a.line = b.line WHERE a.c IS DISTINCT FROM b.c OR a.s IS DISTINCT FROM b.s"))
def compare_profiles(spark, d):
    return tools.compare(*halves(spark, d)).where("aggregate = 'lines'")


@query("compare_same", "SELECT '' AS aggregate, '' AS key, '' AS \"left\", '' AS \"right\" WHERE false")
def compare_same(spark, d):
    p = profile(spark, d)
    return tools.compare(p, tables.profile(spark, d))



@query("merge_concat", sql("", "WITH t AS (SELECT l_orderkey % 2 AS side, l_suppkey AS fid, CAST(l_linenumber AS BIGINT) AS line, CAST(round(l_extendedprice*100) AS BIGINT) AS ticks FROM lineitem), m AS (SELECT max(s_suppkey) AS top FROM supplier) SELECT fid + CASE WHEN side = 1 THEN top ELSE 0 END AS fid, line, count(*) AS calls, CAST(sum(ticks) AS BIGINT) AS ticks FROM t, m GROUP BY 1, 2"))
def merge_concat(spark, d):
    from tickloom.views import Profile

    a, b = halves(spark, d)
    return agg.line_totals(Profile.of(tools.merge_concat([a.events(), b.events()]))).drop(P)


@query("merge_by_name", sql("lines", "SELECT * FROM lines"))
def merge_by_name(spark, d):
    """Both halves name the same files, so merging by name gives the totals of the whole."""
    from tickloom.views import Profile

    a, b = halves(spark, d)
    return agg.line_totals(Profile.of(tools.merge_by_name([a.events(), b.events()]))).drop(P)


@query("normalized_files", sql("new_fid", "SELECT fid, regexp_extract(name, '([^/]*)$', 1) AS name FROM new_fid"))
def normalized_files(spark, d):
    return tools.normalized(profile(spark, d).events()).where("tag = 'NEW_FID'").select("fid", "name")


@query("conversion_problems", sql("time_block", "SELECT 'TIME_BLOCK' AS tag, 'sub_line' AS problem, count(*) AS n FROM time_block"))
def conversion_problems(spark, d):
    return tools.conversion_problems(profile(spark, d).events()).groupBy("tag", "problem").agg(F.count("*").alias("n"))


@query("event_kinds", "SELECT * FROM (VALUES ('COMMENT', true, 0), ('NEW_FID', false, (SELECT count(*) FROM supplier))) v(tag, present, observed)")
def event_kinds(spark, d):
    """Where the tags of the profile aren't those that were expected."""
    tags = ["TIME_LINE", "TIME_BLOCK", "DISCOUNT", "SUB_ENTRY", "SUB_RETURN", "SUB_CALLERS", "SUB_INFO", "SRC_LINE", "ATTRIBUTE", "OPTION", "PID_START", "PID_END", "COMMENT"]
    expected = spark.createDataFrame([*[(t, True) for t in tags], ("NEW_FID", False)], "tag string, present boolean")
    return tools.kinds(profile(spark, d).events(), expected)
