"""Sharding by a K-d tree over metadata, in DataFrame operations only.

Each dimension of a row becomes a 62-bit code that orders rows by value: 31 bits of the value's place among QUANTILES of
the dimension, and 31 bits of a hash of the row. A value that many rows share covers several quantiles, and its rows are
spread over their places by the hash, so a value that a third of the rows have can still be cut, and one outlier changes
nothing. A node that stands for k shards is split along its widest dimension (the largest range of codes of its cell,
ties by order) at the code that leaves floor(k/2)/k of its bytes on the left: the weighted median for even k.

Levels are split breadth first. A histogram for each node of a level, over its cell's range, gives the median's bin; it is
narrowed until a bin is light enough. Codes are near evenly filled, so one histogram a level mostly does. Bins are few
where nodes are many, and of a level of over WIDE nodes only the bin that is sought comes to the driver, a row for each
node: what is collected is bounded by the number of shards, which isn't. Rows go down the tree by arrays of dimensions
and cuts, an entry for each node.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._util import before, discard, stage

QUANTILES, CLOSE = 64, 0.0005
#: Rows of histograms that are collected for a level; nodes from which on bins are sought by Spark.
HISTOGRAM_ROWS, WIDE = 1 << 18, 8192
_HALF = 1 << 31
_ALL = 1 << 62


def _array(values: list, kind: str) -> Column:
    """A constant array, as one literal however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


class Tree:
    """Nodes as in a heap: 1 is the root, 2 i and 2 i + 1 are the children of i."""

    def __init__(self, shards: int, dims: int):
        self.count, self.first = {1: shards}, {1: 0}
        self.dims = dims
        self.cell = {1: [(0, _ALL)] * dims}
        self.dim: dict[int, int] = {}
        self.cut: dict[int, int] = {}
        self.depth = 0

    def open(self) -> list[int]:
        """The nodes of the lowest level that stand for several shards, each with the dimension it will be cut along."""
        level = [i for i in self.cell if self.count[i] > 1 and i not in self.cut]
        for i in level:
            self.dim[i] = max(range(self.dims), key=lambda d, i=i: (self.cell[i][d][1] - self.cell[i][d][0], -d))
        return level

    def split(self, node: int, cut: int) -> None:
        k, half, d = self.count[node], self.count[node] // 2, self.dim[node]
        self.cut[node] = cut
        low, high = self.cell[node][d]
        for child, n, at, cell in ((2 * node, half, 0, (low, cut)), (2 * node + 1, k - half, half, (cut, high))):
            self.count[child], self.first[child] = n, self.first[node] + at
            self.cell[child] = [cell if x == d else c for x, c in enumerate(self.cell[node])]
        del self.cell[node]
        self.depth = max(self.depth, node.bit_length())

    def node_of(self) -> Column:
        """The node that a row's codes (an array `codes`) lead to."""
        size = max(self.cut, default=0) + 1
        dims = _array([self.dim[i] if i in self.cut else -1 for i in range(size)], "int")
        cuts = _array([self.cut.get(i, 0) for i in range(size)], "bigint")

        def down(node, _):
            inside = (node < size) & (F.get(dims, node) >= 0)
            right = (F.get(F.col("codes"), F.get(dims, node)) >= F.get(cuts, node)).cast("int")
            return F.when(inside, 2 * node + right).otherwise(node)

        if not self.depth:
            return F.lit(1)
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), down)


def plan(rows: DataFrame, dims: int, weight: str, shards: int, total: int) -> Tree:
    """The tree over rows (codes, weight), whose weights sum to total."""
    tree = Tree(shards, dims)
    if total <= 0:
        while level := tree.open():
            for i in level:
                tree.split(i, sum(tree.cell[i][tree.dim[i]]) // 2)
        return tree
    weights = {1: total}
    while level := tree.open():
        bins = max(32, min(16_384, HISTOGRAM_ROWS // len(level)))
        node_of = tree.node_of()
        # node -> [from, to, weight before, bytes that go left]
        sought = {i: [*tree.cell[i][tree.dim[i]], 0, weights[i] * (tree.count[i] // 2) / tree.count[i]] for i in level}
        for i in [i for i in level if not weights[i]]:  # no rows: cut anywhere
            weights[2 * i] = weights[2 * i + 1] = 0
            tree.split(i, sum(sought.pop(i)[:2]) // 2)
        while sought:
            found = _bins(rows, node_of, weight, {i: (tree.dim[i], o[0], o[1]) for i, o in sought.items()}, bins, {i: o[3] - o[2] for i, o in sought.items()})
            for i, (b, own, n, up) in found.items():
                low, high, left, goal = sought[i]
                width = _width(low, high, bins)
                a, z = low + b * width, min(high, low + (b + 1) * width)
                start = left + up - own
                if n == 1 or width == 1 or own <= CLOSE * weights[i] / tree.count[i]:
                    nearer = goal - start <= start + own - goal
                    weights[2 * i] = start if nearer else start + own
                    weights[2 * i + 1] = weights[i] - weights[2 * i]
                    tree.split(i, a if nearer else z)
                    del sought[i]
                else:
                    sought[i] = [a, z, start, goal]
    return tree


def _width(low: int, high: int, bins: int) -> int:
    return max(1, -(-(high - low) // bins))


def _bins(rows: DataFrame, node_of: Column, weight: str, cells: dict[int, tuple[int, int, int]], bins: int, goals: dict[int, float]) -> dict[int, tuple[int, int, int, int]]:
    """For each node the bin in which its goal lies: (bin, its weight, its rows, weight up to and with it)."""
    size = max(cells) + 1
    dims, lows, widths = ([0] * size for _ in range(3))
    highs = [-1] * size
    for i, (d, low, high) in cells.items():
        dims[i], lows[i], highs[i], widths[i] = d, low, high, _width(low, high, bins)
    at = rows.select(node_of.alias("node"), "codes", weight).where(F.col("node") < size)
    at = at.select("node", weight, F.get("codes", F.get(_array(dims, "int"), F.col("node"))).alias("code"))
    low, high, width = (F.get(_array(v, "bigint"), F.col("node")) for v in (lows, highs, widths))
    inside = at.where((F.col("code") >= low) & (F.col("code") < high))
    hist = inside.groupBy("node", F.floor((F.col("code") - low) / width).cast("int").alias("b")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    if len(cells) > WIDE:
        goal = F.get(_array([goals.get(i, 0.0) for i in range(size)], "double"), F.col("node"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("up", upto).withColumn("past", F.col("up") > goal)
        here = F.struct(F.when(F.col("past"), 0).otherwise(1).alias("k"), F.when(F.col("past"), F.col("b")).otherwise(-F.col("b")).alias("b"), "w", "n", "up")
        return {r.node: (abs(r.m.b), r.m.w, r.m.n, r.m.up) for r in hist.groupBy("node").agg(F.min(here).alias("m")).collect()}
    by_node: dict[int, list] = {}
    for r in hist.collect():
        by_node.setdefault(r.node, []).append((r.b, r.w, r.n))
    out = {}
    for i, own in by_node.items():
        up = 0
        for b, w, n in sorted(own):
            up += w
            out[i] = (b, w, n, up)
            if up > goals[i]:
                break
    return out


def code(value: Column, quantiles: list[float], salt: Column) -> Column:
    """62 bits that order rows by value, then by salt; nulls first. quantiles ascend."""
    h = F.pmod(salt, F.lit(_HALF))
    if not quantiles:
        return h
    q = _array([float(x) for x in quantiles], "double")
    below = F.size(F.filter(q, lambda x: x < value))
    equal = F.size(F.filter(q, lambda x: x <= value)) - below
    low, high = F.get(q, below - 1), F.get(q, below)
    # an interval for what lies between two quantiles, in proportion; one for each quantile and all between equal ones,
    # where the rows of that value lie anywhere, by the hash
    between = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), F.coalesce((value - low) / (high - low), F.lit(0.5))))
    place = 2 * below + F.when(equal > 0, 1 + h.cast("double") / _HALF * (2 * equal - 1)).otherwise(between)
    place = ((place + 1) / (2 * len(quantiles) + 3) * (_HALF - 1)).cast("long")
    return F.coalesce(place, F.lit(0).cast("long")) * _HALF + h


def kd_shards(docs: DataFrame, *, shards: int = 24, target_bytes: int | None = None, dims: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    size is the text's UTF-8 bytes (none for a null) plus 8; law is `bytes`: shards of near equal size, up to a row's
    size and a 2000th of a shard. With target_bytes the number of shards follows from all bytes. dims are metadata
    columns, by default the string and numeric ones other than text; strings go by a hash of the value, as a category
    has no width; null and NaN come first. slot numbers a shard's rows from 0 in order of a hash of the row, so that no
    id, however far off or often repeated, makes a range heavy; rows repeated as a whole are all kept, and may come in
    any order among themselves. Ids of any type and other columns of any name may be there; texts of any length count
    whole. grown_shard is null: it belongs to another law. An empty table gives none.
    """
    plain = [f for f in docs.schema.fields if f.name not in (text_col,)]
    if dims is None:
        dims = [f.name for f in plain if f.dataType.typeName() in ("string", "integer", "long", "short", "byte", "float", "double", "decimal")]
    kinds = {f.name: f.dataType.typeName() for f in plain}
    text = F.col(f"`{text_col}`").cast("string")
    values = [(F.pmod(F.xxhash64(F.col(f"`{d}`")), F.lit(_HALF)) if kinds[d] == "string" else F.nanvl(F.col(f"`{d}`").cast("double"), F.lit(None).cast("double"))).cast("double").alias(f"v{i}") for i, d in enumerate(dims)]
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    salt = F.xxhash64(*[F.col(f"`{f.name}`") for f in plain if not re.search("map<|variant", f.dataType.simpleString())], text)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), crc.alias("text_crc32"), salt.alias("salt"), *values)
    rows = stage(rows, "kd-rows")
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    ends = rows.agg(F.count("*").alias("n"), F.sum("size").alias("w"), *[F.percentile_approx(f"v{i}", steps, 10_000).alias(f"q{i}") for i in range(len(dims))]).first()
    if target_bytes:
        shards = max(1, -(-(ends.w or 0) // target_bytes))
    codes = [code(F.col(f"v{i}"), ends[f"q{i}"] or [], F.xxhash64("salt", F.lit(i))) for i in range(len(dims))] or [code(F.lit(None).cast("double"), [], F.xxhash64("salt"))]
    coded = stage(rows.select("doc_id", "size", "text_crc32", "salt", F.array(*codes).alias("codes")), "kd-codes")  # read by every level
    discard(rows)
    tree = plan(coded, len(codes), "size", shards, ends.w or 0)
    first = F.lit([tree.first.get(i, 0) for i in range(max(tree.first) + 1)]).cast("array<int>")
    placed = coded.select("doc_id", "size", "text_crc32", "salt", F.get(first, tree.node_of()).alias("shard"))
    return numbered(placed, ends.n or 0, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(placed: DataFrame, count: int, shards: int, rows_each: int = 50_000) -> DataFrame:
    """slot: gapless from 0 in each shard, by salt. Equal ranges of the salt's values, which are spread evenly, split a
    shard's rows; each is numbered on its own and moved by the rows of the ranges before it."""
    parts = max(1, -(-count // (shards * rows_each)))
    part = F.floor(F.shiftrightunsigned("salt", 33).cast("double") / F.lit(float(_HALF)) * parts).cast("int")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.shiftrightunsigned("salt", 33), "salt", "doc_id", "text_crc32", "size")) - 1
    if parts == 1:
        return placed.withColumn("part", F.lit(0)).withColumn("slot", own.cast("long"))
    placed = stage(placed.withColumn("part", part), "kd-placed")
    moved = before(placed, F.count("*"), by=["shard"]).toDF("s", "p", "before")
    return placed.withColumn("own", own).join(moved, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).withColumn("slot", (F.col("own") + F.col("before")).cast("long"))
