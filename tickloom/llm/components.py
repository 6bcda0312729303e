"""Connected components of a link table, as a distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm._util import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each node of a link, the smallest node that it can reach.

    Each round takes the least label among a node's neighbours, then follows that label once more, so that chains
    shorten by half. Neighbours' labels are pre-aggregated before the shuffle; nothing is collected. Null ends and
    self-links are left out; an empty table gives an empty one.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = stage(links.union(links.select("b", "a")).distinct(), "edges")
    at = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = edges.join(at, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        step = at.join(near, F.col("a") == F.col("node"), "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        jump = step.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
        step = step.join(jump, F.col("root") == F.col("r_node"), "left").select("node", F.least("root", F.coalesce("r_root", "root")).alias("root"), "was")
        step = stage(step, "labels")
        at = step.select("node", "root")
        if step.where("root <> was").isEmpty():
            return at
