"""The call graph: folded stacks, package and sub graphs, flame layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom import functions as fn
from tickloom.operators import aggregates as agg
from tickloom.operators.aggregates import P
from tickloom.staging import stage

#: Fixed values of the layout.
WIDTH, ROW_HEIGHT, PADDING, LEAST_WIDTH, MOST_DEPTH = 1200.0, 22.0, 2.0, 1.0, 16


def folded(edges: DataFrame) -> DataFrame:
    """profile_id, line: `caller;called calls` for edges that were called. From call_edges."""
    return edges.where("calls > 0").select(P, F.concat_ws(" ", fn.edge_key("caller", "called", ";"), F.col("calls").cast("string")).alias("line"))


def sub_graph(callers: DataFrame) -> DataFrame:
    """profile_id, caller, called: distinct called edges whose ends have names."""
    return callers.where("calls > 0 AND caller <> '' AND called <> ''").select(P, "caller", "called").distinct()


def package_graph(callers: DataFrame) -> DataFrame:
    """The same between packages. Edges are made distinct before names are cut."""
    return sub_graph(callers).select(P, fn.package_of("caller").alias("caller"), fn.package_of("called").alias("called")).distinct()


def dot_lines(graph: DataFrame) -> DataFrame:
    """profile_id, line: statements of a Graphviz digraph."""
    return graph.select(P, F.concat(fn.dot_quote("caller"), F.lit(" -> "), fn.dot_quote("called"), F.lit(";")).alias("line"))


def callgrind(edges: DataFrame, subs: DataFrame) -> DataFrame:
    """profile_id, name, part, called, calls, cost: part 0 is a function's own cost, part 1 its calls in order of called."""
    live = edges.where("calls > 0")
    names = subs.select(P, "name").union(live.select(P, "caller")).union(live.select(P, "called")).distinct()
    own = names.join(subs, [P, "name"], "left").select(P, "name", F.lit(0).alias("part"), F.lit("").alias("called"), F.lit(0).cast("long").alias("calls"), F.when(F.col("returns").isNull(), F.lit(0).cast("long")).otherwise(fn.callgrind_cost("excl", "returns")).alias("cost"))
    out = live.select(P, F.col("caller").alias("name"), F.lit(1).alias("part"), "called", "calls", fn.callgrind_cost("excl", "calls").alias("cost"))
    return own.union(out)


def flame_edges(edges: DataFrame, subs: DataFrame) -> DataFrame:
    """profile_id, caller, called, calls, weight, rank: no uncalled edges, nameless callees or self-calls. The weight is
    the callee's own inclusive time, else the edge's, else its calls; rank orders siblings."""
    whole = lambda c: F.when(~F.isnan(c) & (c < F.lit(float("inf"))) & (c > 0), c)
    own = subs.select(P, F.col("name").alias("called"), whole(F.col("incl")).alias("own"))
    out = edges.where("calls > 0 AND called <> '' AND caller <> called").join(own, [P, "called"], "left")
    out = out.select(P, "caller", "called", "calls", F.coalesce("own", whole(F.col("incl")), F.col("calls").cast("double")).alias("weight"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(P, "caller").orderBy(F.desc("weight"), "called")))


def flame_roots(flame: DataFrame, subs: DataFrame) -> DataFrame:
    """profile_id, name, calls, weight: callers never called; where a profile has none, all its callers."""
    sums = flame.where("caller <> ''").groupBy(P, F.col("caller").alias("name")).agg(F.sum("weight").alias("children"), F.sum("calls").alias("calls"))
    called = flame.select(P, F.col("called").alias("name")).distinct().withColumn("is_called", F.lit(True))
    marked = sums.join(called, [P, "name"], "left").withColumn("free", F.col("is_called").isNull())
    free = marked.groupBy(P).agg(F.max("free").alias("any_free"))
    kept = marked.join(free, P).where("free OR NOT any_free")
    own = subs.select(P, "name", F.when(~F.isnan("incl") & (F.col("incl") < F.lit(float("inf"))) & (F.col("incl") > 0), F.col("incl")).otherwise(F.lit(0.0)).alias("own"))
    return kept.join(own, [P, "name"], "left").select(P, "name", "calls", F.greatest(F.coalesce("own", F.lit(0.0)), "children", F.lit(1.0)).alias("weight"))


def flame_layout(edges: DataFrame, subs: DataFrame) -> DataFrame:
    """profile_id, depth, name, path, calls, weight, x, width of each frame of at least LEAST_WIDTH.

    A level holds at most WIDTH / LEAST_WIDTH frames a profile, as narrower ones are left out with all above them, so a
    level's join is small whatever the graph; cycles end where a name is on its own path, which is drawn and not opened.
    """
    flame = stage(flame_edges(edges, subs), "flame-edges")  # read again by every level
    before = Window.partitionBy(P, "caller").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    kids = flame.withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0.0))).withColumn("children", F.sum("weight").over(Window.partitionBy(P, "caller")))
    kids = kids.select(F.col(P).alias("k_p"), F.col("caller").alias("k_caller"), F.col("called").alias("k_name"), F.col("calls").alias("k_calls"), F.col("weight").alias("k_weight"), "before", "children")
    order = Window.partitionBy(P).orderBy(F.desc("weight"), "name").rowsBetween(Window.unboundedPreceding, -1)
    roots = flame_roots(flame, subs).withColumn("total", F.sum("weight").over(Window.partitionBy(P))).withColumn("left", F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    kids = stage(kids, "flame-kids")
    roots = roots.select(P, F.lit(0).alias("depth"), "name", F.array("name").alias("path"), F.lit(True).alias("opens"), "calls", "weight", (F.col("left") / F.col("total") * WIDTH).alias("x"), (F.col("weight") / F.col("total") * WIDTH).alias("width"))
    fit = "(width * least(1.0D, children / greatest(weight, children)))"
    step = f"""WITH RECURSIVE frames({P}, depth, name, path, opens, calls, weight, x, width) AS (
        SELECT * FROM {{roots}} WHERE width >= {LEAST_WIDTH}D
        UNION ALL
        SELECT {P}, depth + 1, k_name, concat(path, array(k_name)), NOT array_contains(path, k_name), k_calls, k_weight, x + before / children * {fit}, k_weight / children * {fit}
        FROM frames JOIN {{kids}} ON {P} = k_p AND name = k_caller
        WHERE opens AND depth < {MOST_DEPTH - 1} AND k_weight / children * {fit} >= {LEAST_WIDTH}D)
        SELECT {P}, depth, name, path, calls, weight, x, width FROM frames"""
    return edges.sparkSession.sql(step, roots=stage(roots, "flame-roots"), kids=kids)


def call_paths(graph: DataFrame, roots: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """profile_id, depth, path: all paths from the roots (profile_id, name) without a repeated name. Their number can
    grow with the product of a graph's branchings: meant for trees."""
    edges = graph.select(F.col(P).alias("e_p"), F.col("caller").alias("e_caller"), F.col("called").alias("e_called"))
    level = roots.select(P, F.lit(0).alias("depth"), F.array("name").alias("path"))
    levels = [level]
    for d in range(1, depth):
        level = level.join(edges, (F.col(P) == F.col("e_p")) & (F.element_at("path", -1) == F.col("e_caller"))).where(~F.array_contains("path", F.col("e_called"))).select(P, F.lit(d).alias("depth"), F.concat("path", F.array("e_called")).alias("path"))
        levels.append(level)
    return reduce(DataFrame.unionAll, levels)
