"""Derived report relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom.operators import aggregates as agg
from tickloom.operators import derived, graph
from tickloom.operators.aggregates import P
from tickloom.plans.registry import query, sql
from tickloom.sources.projections import call_returns, profile, tree_callers

_BASE = "regexp_extract(name, '([^/]*)$', 1)"


@query("exclusive_ranking", sql("subs", "SELECT name, returns, incl, excl, row_number() OVER (ORDER BY excl DESC, name) AS rank FROM subs"))
def exclusive_ranking(spark, d):
    return derived.exclusive_ranking(call_returns(spark, d)).drop(P)


@query("top_subs", sql("subs", "SELECT name, returns, excl, row_number() OVER (ORDER BY excl DESC, name) AS rank FROM subs QUALIFY rank <= 15"))
def top_subs(spark, d):
    return derived.exclusive_ranking(call_returns(spark, d), 15).select("name", "returns", "excl", "rank")


@query("edge_ranking", sql("edges", "SELECT caller, called, calls, incl, excl, row_number() OVER (ORDER BY calls DESC, caller, called) AS rank FROM edges"))
def edge_ranking(spark, d):
    return derived.edge_ranking(profile(spark, d)["SUB_CALLERS"]).select("caller", "called", "calls", "incl", "excl", "rank")


_Q = "quantile_cont(CAST({0} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({0} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({0} AS DOUBLE), 0.75) AS q3, max({0}) > min({0}) AS spread"


@query("quartiles", sql("subs edges timing lines", f"SELECT 'subs' AS \"table\", {_Q.format('excl')} FROM subs UNION ALL SELECT 'edges', {_Q.format('excl')} FROM edges UNION ALL SELECT 'lines', {_Q.format('ticks')} FROM lines WHERE ticks > 0 UNION ALL SELECT 'files', {_Q.format('ticks')} FROM (SELECT sum(ticks) AS ticks FROM timing GROUP BY fid)"))
def quartiles(spark, d):
    p = profile(spark, d)
    out = derived.quartiles(agg.sub_totals(call_returns(spark, d)), "excl", "subs")
    out = out.union(derived.quartiles(agg.call_edges(p["SUB_CALLERS"]), "excl", "edges"))
    out = out.union(derived.quartiles(agg.line_totals(p).where("ticks > 0"), "ticks", "lines"))
    return out.union(derived.quartiles(agg.file_totals(p), "ticks", "files")).drop(P)


_HEAT = "CASE WHEN {0} = 0 OR NOT spread THEN '' WHEN {0} >= q3 THEN 'hot' WHEN {0} >= q2 THEN 'high' WHEN {0} >= q1 THEN 'mid' ELSE 'low' END"


@query("sub_heat", sql("subs", f"SELECT name, returns, incl, excl, {_HEAT.format('excl')} AS excl_heat, {_HEAT.format('incl')} AS incl_heat FROM subs, (SELECT {_Q.format('excl')} FROM subs)"))
def sub_heat(spark, d):
    return derived.sub_heat(call_returns(spark, d)).drop(P)


@query("edge_heat", sql("edges", f"SELECT caller, called, calls, {_HEAT.format('excl')} AS heat FROM edges, (SELECT {_Q.format('excl')} FROM edges)"))
def edge_heat(spark, d):
    return derived.with_heat(agg.call_edges(profile(spark, d)["SUB_CALLERS"]), "excl").select("caller", "called", "calls", "heat")


@query("file_heat", sql("timing", f"SELECT fid, ticks, {_HEAT.format('ticks')} AS heat FROM (SELECT fid, CAST(sum(ticks) AS BIGINT) AS ticks FROM timing GROUP BY 1), (SELECT {_Q.format('t')} FROM (SELECT sum(ticks) AS t FROM timing GROUP BY fid))"))
def file_heat(spark, d):
    return derived.with_heat(agg.file_totals(profile(spark, d)), "ticks").select("fid", "ticks", "heat")


@query("line_heat", sql("lines", f"SELECT fid, line, calls, ticks, ticks_heat, {_HEAT.format('calls')} AS calls_heat FROM (SELECT l.*, {_HEAT.format('ticks')} AS ticks_heat FROM lines l, (SELECT {_Q.format('ticks')} FROM lines WHERE ticks > 0)), (SELECT {_Q.format('calls')} FROM lines WHERE calls > 0)"))
def line_heat(spark, d):
    return derived.line_heat(profile(spark, d)).drop(P)


@query("index_totals", sql("timing call_return new_fid", "SELECT (SELECT count(*) FROM timing) AS statements, (SELECT CAST(sum(ticks) AS BIGINT) FROM timing) AS ticks, (SELECT count(*) FROM call_return) AS sub_calls, (SELECT count(*) FROM new_fid) AS files, CAST((SELECT CAST(sum(ticks) AS BIGINT) FROM timing) AS DOUBLE) / 10000000 AS active"))
def index_totals(spark, d):
    return derived.index_totals(profile(spark, d), call_returns(spark, d)).drop(P, "wall")


@query("places_and_files", sql("sub_callers defs", "SELECT called, count(DISTINCT caller) AS places, greatest(1, count(DISTINCT d.fid)) AS files FROM (SELECT DISTINCT caller, called FROM sub_callers) e LEFT JOIN defs d ON d.name = e.caller GROUP BY 1"))
def places_and_files(spark, d):
    p = profile(spark, d)
    return derived.places_and_files(p["SUB_CALLERS"], agg.sub_defs(p)).drop(P)


@query("calls_from_lines", sql("usable", "SELECT fid, line, called, CAST(sum(calls) AS BIGINT) AS calls, sum(incl) AS incl FROM usable GROUP BY 1, 2, 3"))
def calls_from_lines(spark, d):
    p = profile(spark, d)
    return derived.calls_from_lines(p["SUB_CALLERS"], agg.sub_defs(p)).drop(P)


@query("calls_into_lines", sql("usable", "SELECT d.fid, d.first_line AS line, u.called, u.caller, u.fid AS from_fid, u.line AS from_line, u.calls FROM usable u JOIN defs d ON d.name = u.called AND d.first_line > 0"))
def calls_into_lines(spark, d):
    p = profile(spark, d)
    return derived.calls_into_lines(p["SUB_CALLERS"], agg.sub_defs(p)).drop(P)


@query("eligible_files", sql("new_fid src_line timing", "SELECT fid FROM new_fid WHERE fid IN (SELECT fid FROM src_line) OR fid IN (SELECT fid FROM timing)"))
def eligible_files(spark, d):
    return derived.eligible_files(profile(spark, d)).drop(P)


@query("primary_file", sql("new_fid timing", f"SELECT fid, 2 AS rule FROM new_fid LEFT JOIN (SELECT fid, sum(ticks) AS t FROM timing GROUP BY 1) USING (fid) WHERE ends_with({_BASE}, '.pl') ORDER BY coalesce(t, 0) DESC, fid LIMIT 1"))
def primary_file(spark, d):
    return derived.primary_file(profile(spark, d)).select("fid", "rule")


@query("source_page", sql("src_line lines blocks", "SELECT coalesce(s.fid, l.fid, b.fid) AS fid, coalesce(s.line, l.line, b.block_line) AS line, coalesce(text, '-') AS text, coalesce(l.calls, -1) AS calls, coalesce(l.ticks, -1) AS ticks, coalesce(b.calls, -1) AS block_calls, coalesce(b.ticks, -1) AS block_ticks FROM (SELECT fid, line, arg_max(text, seq) AS text FROM src_line GROUP BY 1, 2) s FULL JOIN lines l ON s.fid = l.fid AND s.line = l.line FULL JOIN blocks b ON coalesce(s.fid, l.fid) = b.fid AND coalesce(s.line, l.line) = b.block_line"))
def source_page(spark, d):
    return derived.source_page(profile(spark, d)).drop(P).fillna("-", ["text"]).fillna(-1)


def _core(spark, d):
    """Callers view in which some names are built-in operations, with no definition."""
    c = profile(spark, d)["SUB_CALLERS"]
    return c.withColumn("called", F.regexp_replace("called", "::f(1|7|13)$", "::CORE:$1"))


_CORE_SQL = "core AS (SELECT fid, line, calls, incl, caller, regexp_replace(called, '::f(1|7|13)$', '::CORE:\\1') AS called FROM sub_callers)"


def _core_sql(names: str, body: str) -> str:
    return sql(names, "@" + body).replace(" @", f", {_CORE_SQL} ")


@query("core_names", _core_sql("sub_callers", "SELECT DISTINCT called AS name FROM core WHERE called LIKE '%CORE:%'"))
def core_names(spark, d):
    return derived.core_names(_core(spark, d)).drop(P)


@query("undefined_core_calls", _core_sql("sub_callers defs", "SELECT called, count(*) AS sites, CAST(sum(calls) AS BIGINT) AS calls FROM (SELECT called, caller, fid, line, sum(calls) AS calls FROM core WHERE called LIKE '%CORE:%' AND called NOT IN (SELECT name FROM defs) AND fid <> 0 AND line <> 0 AND (NOT (fid = 1 AND line = 1) OR caller IN (SELECT name FROM defs WHERE fid = 1 AND first_line = 1)) GROUP BY ALL) GROUP BY 1"))
def undefined_core_calls(spark, d):
    return derived.undefined_calls(_core(spark, d), agg.sub_defs(profile(spark, d))).drop(P)


@query("subs_of_file", _core_sql("sub_callers defs new_fid timing", f"SELECT d.fid, d.name FROM defs d WHERE d.name IN (SELECT called FROM core) UNION SELECT d.fid, c.called FROM core c JOIN defs d ON d.name = c.caller OR d.name = c.called WHERE c.called LIKE '%CORE:%' UNION SELECT p.fid, c.called FROM core c, (SELECT fid FROM new_fid LEFT JOIN (SELECT fid, sum(ticks) AS t FROM timing GROUP BY 1) USING (fid) WHERE ends_with({_BASE}, '.pl') ORDER BY coalesce(t, 0) DESC, fid LIMIT 1) p WHERE c.called LIKE '%CORE:%'"))
def subs_of_file(spark, d):
    p, c = profile(spark, d), _core(spark, d)
    returns = c.select(P, "seq", F.col("called").alias("name"))
    return derived.subs_of_file(c, returns, agg.sub_defs(p), derived.primary_file(p)).drop(P)


@query("definition_coverage", sql("call_return defs", "SELECT name, count(*) AS returns, name IN (SELECT name FROM defs) AS defined FROM call_return GROUP BY 1"))
def definition_coverage(spark, d):
    return derived.definition_coverage(call_returns(spark, d), agg.sub_defs(profile(spark, d))).drop(P)


@query("folded_stacks", sql("edges", "SELECT caller || ';' || called || ' ' || calls AS line FROM edges WHERE calls > 0"))
def folded_stacks(spark, d):
    return graph.folded(agg.call_edges(profile(spark, d)["SUB_CALLERS"])).drop(P)


@query("callgrind", sql("edges subs", "SELECT name, 0 AS part, '' AS called, 0 AS calls, CAST(coalesce(excl, 0) AS BIGINT) AS cost FROM (SELECT caller AS name FROM edges UNION SELECT called FROM edges UNION SELECT name FROM subs) LEFT JOIN subs USING (name) UNION ALL SELECT caller, 1, called, calls, CAST(excl AS BIGINT) FROM edges WHERE calls > 0"))
def callgrind(spark, d):
    return graph.callgrind(agg.call_edges(profile(spark, d)["SUB_CALLERS"]), agg.sub_totals(call_returns(spark, d))).drop(P)


@query("package_graph", sql("sub_callers", "SELECT DISTINCT regexp_extract(caller, '^(.+)::', 1) AS caller, regexp_extract(called, '^(.+)::', 1) AS called FROM sub_callers WHERE calls > 0"))
def package_graph(spark, d):
    return graph.package_graph(profile(spark, d)["SUB_CALLERS"]).drop(P)


@query("sub_graph_dot", sql("sub_callers", "SELECT DISTINCT '\"' || caller || '\" -> \"' || called || '\";' AS line FROM sub_callers WHERE calls > 0"))
def sub_graph_dot(spark, d):
    return graph.dot_lines(graph.sub_graph(profile(spark, d)["SUB_CALLERS"])).drop(P)


@query("flame_edges", sql("kids", "SELECT caller, called, calls, weight, row_number() OVER (PARTITION BY caller ORDER BY weight DESC, called) AS rank FROM kids"))
def flame_edges(spark, d):
    return graph.flame_edges(agg.call_edges(profile(spark, d)["SUB_CALLERS"]), agg.sub_totals(call_returns(spark, d))).drop(P)


@query("flame_roots", sql("kids subs", "SELECT caller AS name, calls, greatest(coalesce(incl, 0.0), w, 1.0) AS weight FROM (SELECT caller, CAST(sum(calls) AS BIGINT) AS calls, sum(weight) AS w FROM kids WHERE caller <> '' GROUP BY 1) k LEFT JOIN subs ON name = caller WHERE caller NOT IN (SELECT called FROM kids) OR NOT EXISTS (SELECT 1 FROM kids a WHERE a.caller <> '' AND a.caller NOT IN (SELECT called FROM kids))"))
def flame_roots(spark, d):
    subs = agg.sub_totals(call_returns(spark, d))
    return graph.flame_roots(graph.flame_edges(agg.call_edges(profile(spark, d)["SUB_CALLERS"]), subs), subs).drop(P)


def _tree(spark, d):
    edges = agg.call_edges(tree_callers(spark, d))
    return edges, agg.sub_totals(spark.createDataFrame([], "profile_id string, name string, incl double, excl double"))


_TREE_KIDS = "tk AS (SELECT caller, called, CAST(sum(calls) AS BIGINT) AS calls, CAST(CASE WHEN sum(incl) > 0 THEN sum(incl) ELSE sum(calls) END AS DOUBLE) AS weight FROM tree GROUP BY 1, 2)"


@query("call_tree", sql("tree", f"RECURSIVE {_TREE_KIDS}, r AS (SELECT 0 AS depth, 'main::RUNTIME' AS name, 'main::RUNTIME' AS path UNION ALL SELECT depth + 1, called, path || '/' || called FROM r JOIN tk ON caller = r.name WHERE depth < 15) SELECT_FROM SELECT depth, path FROM r"))
def call_tree(spark, d):
    callers = tree_callers(spark, d)
    roots = spark.createDataFrame([("tpch", "main::RUNTIME")], "profile_id string, name string")
    return graph.call_paths(graph.sub_graph(callers), roots).select("depth", F.array_join("path", "/").alias("path"))


@query("flame_layout", sql("tree", f"RECURSIVE {_TREE_KIDS}, k AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY caller ORDER BY weight DESC, called ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY caller) AS children FROM tk), r AS (SELECT 0 AS depth, 'main::RUNTIME' AS name, greatest((SELECT sum(weight) FROM tk WHERE caller = 'main::RUNTIME'), 1.0) AS weight, 0.0::DOUBLE AS x, 1200.0::DOUBLE AS width UNION ALL SELECT depth + 1, called, k.weight, x + before / children * (width * least(1.0, children / greatest(r.weight, children))), k.weight / children * (width * least(1.0, children / greatest(r.weight, children))) FROM r JOIN k ON k.caller = r.name WHERE depth < 15 AND k.weight / children * (width * least(1.0, children / greatest(r.weight, children))) >= 1.0) SELECT_FROM SELECT depth, name, CAST(round(x * 1000) AS BIGINT) AS x_milli, CAST(round(width * 1000) AS BIGINT) AS width_milli FROM r"))
def flame_layout(spark, d):
    return graph.flame_layout(*_tree(spark, d)).select("depth", "name", F.round(F.col("x") * 1000).cast("long").alias("x_milli"), F.round(F.col("width") * 1000).cast("long").alias("width_milli"))


_FIT = "(r.width * least(1.0, children / greatest(r.weight, children)))"


@query("flame_layout_cyclic", sql("kids subs", f"RECURSIVE k AS (SELECT caller, called, weight, sum(weight) OVER (PARTITION BY caller) AS children FROM kids), o AS (SELECT caller AS name, greatest(coalesce(any_value(incl), 0.0), any_value(w), 1.0) AS weight FROM (SELECT caller, sum(weight) AS w FROM kids GROUP BY 1) LEFT JOIN subs ON name = caller WHERE caller NOT IN (SELECT called FROM kids) OR NOT EXISTS (SELECT 1 FROM kids a WHERE a.caller NOT IN (SELECT called FROM kids)) GROUP BY caller), r AS (SELECT 0 AS depth, name, [name] AS path, true AS opens, weight, weight / sum(weight) OVER () * 1200.0 AS width FROM o UNION ALL SELECT depth + 1, k.called, list_append(path, k.called), NOT list_contains(path, k.called), k.weight, k.weight / children * {_FIT} FROM r JOIN k ON k.caller = r.name WHERE opens AND depth < 15 AND k.weight / children * {_FIT} >= 1.0) SELECT_FROM SELECT depth, array_to_string(path, '/') AS path, CAST(floor(width * 1000) AS BIGINT) AS width_milli FROM r WHERE width >= 1.0"))
def flame_layout_cyclic(spark, d):
    """A dense, cyclic graph: every caller is a root, and cycles end where a name repeats."""
    frames = graph.flame_layout(agg.call_edges(profile(spark, d)["SUB_CALLERS"]), agg.sub_totals(call_returns(spark, d)))
    return frames.select("depth", F.array_join("path", "/").alias("path"), F.floor(F.col("width") * 1000).cast("long").alias("width_milli"))


@query("subs_csv", sql("subs", "SELECT name || ',' || returns || ',' || CAST(incl AS BIGINT) || ',' || CAST(excl AS BIGINT) AS line FROM subs"))
def subs_csv(spark, d):
    s = agg.sub_totals(call_returns(spark, d))
    return s.select(F.concat_ws(",", fn.csv_field("name"), F.col("returns").cast("string"), fn.format_ticks("incl"), fn.format_ticks("excl")).alias("line"))


@query("csv_quoting", "SELECT p_partkey, CASE WHEN regexp_matches(t, '[,\"\\r\\n]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END AS field FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ',\"' ELSE p_name END AS t FROM part)")
def csv_quoting(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(',"'))).otherwise(F.col("p_name"))
    return part.select("p_partkey", fn.csv_field(t).alias("field"))
