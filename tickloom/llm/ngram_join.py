"""N-gram Jaccard join: near-duplicate documents by exact word n-gram similarity, with connected components.

The document x n-gram incidence matrix is multiplied with its transpose in blocks, never as a whole:

1. Equal texts become one class, so copies cost one row however many there are.
2. A class keeps the prefix of its n-gram set that the size bound allows: two sets with Jaccard t share an n-gram among
   the first |x| - ceil(t |x|) + 1 of each in any common order. The order puts frequent n-grams last (heavy hitters
   counted over every text), so that a passage in very many documents hardly ever starts a block.
3. The classes with one prefix n-gram form a block; its least class is the block's centre. Each pair of a block meets
   in the group of that centre.
4. In a group, pairs that the size bound or the bound from set bitmaps (symmetric difference >= Hamming distance)
   excludes are discarded; this moves some bytes per class, no texts. What is left falls into candidate components.
5. The texts of those components alone are fetched, each once. Overlap counts are accumulated over an inverted n-gram
   index with exact word identities, and pairs with 100 * overlap >= percent * union are linked.
   In 4 and 5 a group too large for a task is dealt to tiles, each of which also gets the same few members (leaders)
   of the group, so that the tiles' components of near copies grow together. Only members outside the group's
   largest component then still have to meet the other tiles: they alone are sent to all of them. A group of near
   copies so moves about once, and every pair of members is compared or known to be in one component. A task
   puts out a spanning forest, never all pairs of a group.
6. Components over the links' classes give each document the smallest document id that it reaches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tickloom.llm import _scan
from tickloom.llm._util import Bloom, Forest, grouped, release, stage, whole
from tickloom.llm.components import components
from tickloom.shipping import ship

#: Most heavy hitters that are broadcast (8 bytes and a rank byte each). They only order prefixes; links don't depend on them.
HOT_NGRAMS = 200_000
#: Texts of one count of heavy hitters, in n-grams: n-grams in fewer than HOT_LEAST texts of a count are dropped from it.
HOT_CHUNK, HOT_LEAST = 1_000_000, 3
#: A tile has about this many classes, and n-grams, at most.
TILE_ROWS, TILE_NGRAMS = 1024, 200_000
#: About so many members of a large group meet all the others in the first round.
LEADERS = 16


def _sets(buf, offsets, k):
    """The set of n-gram hashes of each text; a text of fewer than k words has one, of all of them."""
    words = _scan.Words(buf, offsets, _scan.SPACED)
    h = _scan.fold(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(_scan.fold(words.hashes[a:b], b - a))
        else:
            out.append(h[:0])
    return out


def _count_hot(k):
    def run(batches):
        held, size = [], 0

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n = u[n >= HOT_LEAST], n[n >= HOT_LEAST]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for part in _scan.slices(batch, "text"):
                for s in _sets(*_scan.texts(part.column("text")), k):
                    held.append(s)
                    size += len(s)
                    if size >= HOT_CHUNK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
        held = []
        release()

    return run


def bitmap(s: np.ndarray) -> bytes:
    """A set as 2 to 4 bits an element, a power of two of them, 64 at least."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    m = np.zeros(bits, dtype=bool)
    m[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(m, bitorder="little").tobytes()


def _signatures(k, percent, hot, rank):
    def run(batches):
        hot_h, hot_rank = (hot.value, rank.value)
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                raw, node, size, prefix, bits = part.column("text").to_pylist(), [], [], [], []
                for i, s in enumerate(_sets(*_scan.texts(part.column("text")), k)):
                    n = len(s)
                    node.append(None if raw[i] is None else hashlib.md5(raw[i].encode(), usedforsecurity=False).digest())
                    size.append(n)
                    if not n:
                        prefix.append([])
                        bits.append(b"")
                        continue
                    keep = n - -(-percent * n // 100) + 1
                    at = np.searchsorted(hot_h, s)
                    at[at == len(hot_h)] = 0
                    r = np.where(hot_h[at] == s, hot_rank[at], 0) if len(hot_h) else np.zeros(n, dtype=np.int8)
                    prefix.append(s[np.lexsort((s, r))[:keep]].view(np.int64) if r.any() else s[:keep].view(np.int64))
                    bits.append(bitmap(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.binary()), part.column("doc_id"), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["node", "doc_id", "n", "prefix", "bits"],
                )
        release()

    return run


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _maybe(percent):
    """A spanning forest of the pairs of a tile that the bounds don't separate."""

    def run(table):
        n = table.column("n").to_numpy().astype(np.int64)
        order = np.argsort(n, kind="stable")
        n, side = n[order], table.column("tile").to_numpy()[order]
        bits, node = table.column("bits").to_pylist(), table.column("node").to_pylist()
        by_width: dict[int, list[int]] = {}
        for i, k in enumerate(order.tolist()):
            by_width.setdefault(len(bits[k]) // 8, []).append(i)
        maps = {w: np.frombuffer(b"".join(bits[order[i]] for i in rows), dtype=np.uint64).reshape(len(rows), w) for w, rows in by_width.items()}
        place = {i: (w, j) for w, rows in by_width.items() for j, i in enumerate(rows)}
        cross = table.column("ti")[0].as_py() != table.column("tj")[0].as_py()
        last = np.searchsorted(n, n * 100 // percent, "right")
        forest, links, views = Forest(len(n)), [], {}
        for i in range(len(n) - 1):
            if last[i] <= i + 1:
                continue
            w, at = place[i]
            mine = maps[w][at]
            for w2, rows in by_width.items():
                a, b = np.searchsorted(rows, (i + 1, last[i]))
                if a == b:
                    continue
                if (w, w2) not in views:
                    views[w, w2] = _folded(maps[w2], min(w, w2))
                own = mine if w <= w2 else _folded(mine[None], w2)[0]
                apart = np.bitwise_count(views[w, w2][a:b] ^ own).sum(axis=1, dtype=np.int64)
                js = np.asarray(rows[a:b])
                total = n[i] + n[js]
                most = np.minimum((total - apart) // 2, n[i])
                ok = 100 * most >= percent * (total - most)
                if cross:
                    ok &= side[js] != side[i]
                links += [(i, j) for j in js[ok].tolist() if forest.join(i, j)]
        return [(node[order[i]], node[order[j]]) for i, j in links]

    return run


def _in_blocks(may):
    def run(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            flat = prefix.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(batch.column("nid").to_numpy(), pa.compute.list_value_length(prefix).to_numpy(zero_copy_only=False))
            keep = may(flat)
            yield pa.RecordBatch.from_arrays([pa.array(owner[keep]), pa.array(flat[keep])], ["nid", "s"])

    return run


def _wanted(may):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may(batch.column("h").to_numpy())))

    return run


def _tiles_of(rows: str, ngrams: str) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.expr(rows) / TILE_ROWS), F.ceil(F.expr(ngrams) / TILE_NGRAMS)).cast("int")


def _first_round(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each member in one tile of its group, the leaders of a large group in all of them: center, ti, tj, tile, node."""
    rows = members.join(sizes, "center").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    leads = (F.col("tiles") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("c") / LEADERS)) == 0)
    at = F.when(leads, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    return rows.select("center", "node", F.explode(at).alias("ti")).withColumn("tj", F.col("ti")).withColumn("tile", F.col("ti"))


def _second_round(members: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the large groups, the members outside the group's largest component with all the others: the same columns."""
    rows = members.join(sizes.where("tiles > 1").select("center"), "center").join(roots, "node", "left")
    rows = stage(rows.select("center", "node", "n", F.coalesce("root", "node").alias("root")), "large")
    main = rows.groupBy("center", "root").agg(F.count("*").alias("k")).groupBy(F.col("center").alias("m_center")).agg(F.max(F.struct("k", "root"))["root"].alias("main"))
    main = stage(main, "main")
    rows = rows.join(main, F.col("center") == F.col("m_center")).select("center", "node", "n", (F.col("root") != F.col("main")).alias("rest"))
    tiles = rows.groupBy(F.col("center").alias("t_center")).agg(
        F.count_if("rest").alias("r"), F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0)).alias("rn"), F.count_if(~F.col("rest")).alias("m"), F.sum(F.when(F.col("rest"), 0).otherwise(F.col("n"))).alias("mn")
    )
    tiles = stage(tiles.where("r > 0").select("t_center", _tiles_of("r", "rn").alias("rt"), _tiles_of("m", "mn").alias("mt")), "tiles")
    rows = rows.join(tiles, F.col("center") == F.col("t_center"))
    h = F.xxhash64("node")
    rows = rows.withColumn("tile", F.when(F.col("rest"), F.pmod(h, F.col("rt"))).otherwise(F.col("rt") + F.pmod(h, F.col("mt"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("rt") + F.col("mt")).otherwise(F.col("rt")) - 1)
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("center", "node", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile")


def _roots(members: DataFrame, payload: DataFrame, fn) -> DataFrame:
    """node, root: components of the links between members (center, node, n) of one group, by fn over tiles of their
    payload (by node). They are those that all pairs of a group would give."""
    sizes = members.groupBy("center").agg(F.count("*").alias("c"), _tiles_of("count(*)", "sum(n)").alias("tiles"))
    sizes = stage(sizes.where("c > 1"), "sizes")
    keys, schema = ["center", "ti", "tj"], "a binary, b binary"
    links = stage(grouped(_first_round(members, sizes).join(payload, "node"), keys, fn, schema), "links")
    roots = components(links)
    if sizes.where("tiles > 1").isEmpty():
        return roots
    apart = _second_round(members, sizes, roots)
    if apart.isEmpty():  # every large group is one component
        return roots
    more = stage(grouped(apart.join(payload, "node"), keys, fn, schema), "links")
    return roots if more.isEmpty() else components(links.union(more))


def _exact_sets(raw: list[str], k: int) -> list[np.ndarray]:
    """N-gram sets of these texts with identities instead of hashes: numbers for words, for pairs, for n-grams."""
    vocabulary: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    ids, sizes = [], []
    for t in raw:
        w = [vocabulary.setdefault(x, len(vocabulary)) for x in t.encode().translate(_scan.LOWER.tobytes()).split()] if t else []
        # bytes.split() parts at the six separators: 0x20 and 0x09-0x0D
        if 0 < len(w) < k:
            short.setdefault(tuple(w), len(short))
        ids.append(np.array(w, dtype=np.int64))
        sizes.append(len(w))
    grams, span = ids, 1
    while span < k:
        step = min(span, k - span)
        pairs = [(g[: len(g) - step], g[step:]) if len(g) > step else (g[:0], g[:0]) for g in grams]
        flat = [a * (1 << 31) + b for a, b in pairs]
        _, inverse = np.unique(np.concatenate(flat), return_inverse=True)
        cuts = np.cumsum([len(x) for x in flat])[:-1]
        grams, span = np.split(inverse.astype(np.int64), cuts), span + step
    return [np.unique(g) if s >= k else np.array([-1 - short[tuple(w.tolist())]]) if s else g[:0] for g, w, s in zip(grams, ids, sizes)]


def _linked(k, percent):
    """A spanning forest of the links in a tile, from overlap counts over its inverted index."""

    def run(table):
        node = table.column("node").to_pylist()
        once = list({x: i for i, x in enumerate(node)}.values())  # a text that is there twice
        if len(once) < 2:
            return []
        raw, tile = table.column("text").to_pylist(), table.column("tile").to_numpy()
        sets = _exact_sets([raw[i] for i in once], k)
        del raw
        order = sorted(range(len(once)), key=lambda i: (len(sets[i]), node[once[i]]))
        sets, node, side = [sets[i] for i in order], [node[once[i]] for i in order], tile[[once[i] for i in order]]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        cross = table.column("ti")[0].as_py() != table.column("tj")[0].as_py()
        _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        inverse = inverse.astype(np.int32)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), n)
        by = np.argsort(inverse, kind="stable")
        posting, first = owner[by], np.searchsorted(inverse[by], np.arange(int(inverse.max()) + 2))
        del sets, owner, by
        cuts = np.concatenate([[0], np.cumsum(n)])
        last = np.searchsorted(n, n * 100 // percent, "right")
        forest, out = Forest(len(n)), []
        for i in range(len(n) - 1):
            if last[i] <= i + 1:
                continue
            g = inverse[cuts[i] : cuts[i + 1]]
            a, b = first[g], first[g + 1]
            lengths = b - a
            reach = np.repeat(a - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
            overlap = np.bincount(posting[reach], minlength=len(n))
            js = np.arange(i + 1, last[i])
            ok = 100 * overlap[js] >= percent * (n[i] + n[js] - overlap[js])
            if cross:
                ok &= side[js] != side[i]
            out += [(node[i], node[j]) for j in js[ok].tolist() if forest.join(i, j)]
        return out

    return run


def ngram_join(docs: DataFrame, *, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    A document's set holds its distinct n-grams of words between white space, A-Z lower-cased; with fewer than n words
    the whole sequence is its only one. Documents are linked when 100 * |intersection| >= percent * |union|;
    component_id is the smallest id reachable by links, the document's own included. Null and wordless texts have an
    empty set and are linked with nothing, not even with each other. Null ids are ignored as a component's name unless
    no other is there. Repeated rows come out as often as they went in; other columns are ignored; empty in, empty out.
    """
    return _classified(docs, n, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def deduplicate(docs: DataFrame, *, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of linked documents: that of the smallest id; rows without words all stay.

    Groups are told apart by their root, not by an id: ids may be null, or shared by documents that aren't linked. Ids of
    any type that can be ordered, texts of any length, and columns of any name are taken; an empty table gives none.
    Rows that are the only one of their group, nearly all as a rule, aren't moved: a Bloom filter over the others lets
    them through, and only what it holds back is joined with the decisions. Repeated rows of a kept id and text become one.
    """
    found = stage(_classified(docs, n, percent, id_col, text_col).where("n_shingles > 0").groupBy("key", "node", "doc_id", "root", "component_id").agg(F.count("*").alias("c")), "dedup")
    kept = found.where("doc_id <=> component_id").groupBy("root").agg(F.min(F.struct("key", "node")).alias("k")).select(F.col("root").alias("kept_root"), "k.*")
    kept = stage(kept.select("kept_root", F.col("key").alias("kept_key"), F.col("node").alias("kept_node")), "kept")
    ask = found.join(kept, F.col("root") == F.col("kept_root"), "left").withColumn("keep", F.expr("key <=> kept_key AND node <=> kept_node"))
    ask = stage(ask.where("NOT keep OR c > 1").select(F.col("key").alias("a_key"), F.col("node").alias("a_node"), "keep"), "dedup-ask")
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(whole(docs), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), F.unhex(F.md5(text)).alias("node"))
    may = Bloom(ask, "a_key").test()

    def run(batches):
        for batch in batches:
            asked = pa.array(may(batch.column("key").to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, asked], [*batch.schema.names, "asked"])

    keyed = keyed.mapInArrow(run, StructType([*keyed.schema.fields, StructField("asked", BooleanType())]))
    free = keyed.where("NOT asked").select("row.*")
    held = stage(keyed.where("asked").join(ask, F.expr("key = a_key AND node <=> a_node"), "left").where("keep IS NULL OR keep").select("row", "key", "node", "keep"), "dedup-held")
    return free.unionByName(held.where("keep IS NULL").select("row.*")).unionByName(held.where("keep").dropDuplicates(["key", "node"]).select("row.*"))


def _classified(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hot = docs.select("text").mapInArrow(_count_hot(n), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT_NGRAMS).toArrow()
    hot_h = hot["h"].to_numpy().view(np.uint64)
    order = np.argsort(hot_h)
    hot_rank = np.log2(np.maximum(2, hot["n"].to_numpy().astype(np.float64))).astype(np.int8)[order]
    hot_h, hot_rank = spark.sparkContext.broadcast(hot_h[order]), spark.sparkContext.broadcast(hot_rank)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(_signatures(n, percent, hot_h, hot_rank), f"node binary, doc_id {kind}, n int, prefix array<long>, bits binary")
    classes = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = stage(classes.withColumn("nid", F.expr("conv(substr(hex(node), 1, 15), 16, 10)").cast("long")), "classes")
    hot_h.unpersist()
    hot_rank.unpersist()

    rows = classes.select("nid", F.explode("prefix").alias("s"))
    blocks = stage(rows.groupBy("s").agg(F.count("*").alias("c"), F.min("nid").alias("center")).where("c > 1").select("s", "center"), "blocks")
    may = Bloom(blocks, "s")
    rows = classes.select("nid", "prefix").mapInArrow(_in_blocks(may.test()), "nid long, s long")
    pairs = rows.join(blocks, "s").select("center", "nid").distinct()
    pairs = stage(pairs.join(classes.select("nid", "node", "n"), "nid").select("center", "node", "n"), "groups")
    may.unpersist()
    maybe = _roots(pairs, classes.select("node", "n", "bits"), _maybe(percent))

    named = classes.select("node", "n", F.col("doc_id").alias("rep"))
    maybe = stage(maybe.join(named, "node").select("node", "n", "rep", F.xxhash64("node", "rep").alias("h"), F.xxhash64("root").alias("center")), "maybe")
    source = docs.where("text is not null").withColumn("node", F.unhex(F.md5("text"))).select(F.xxhash64("node", "doc_id").alias("h"), "text")
    may = Bloom(maybe, "h")
    source = source.mapInArrow(_wanted(may.test()), "h long, text string").withColumn("d_node", F.unhex(F.md5("text")))
    texts = stage(maybe.select("h", "node").join(source, (maybe["h"] == source["h"]) & (maybe["node"] == source["d_node"])).select("node", "text"), "texts")
    may.unpersist()
    roots = _roots(maybe.select("center", "node", "n"), texts, _linked(n, percent))

    at = stage(classes.select("node", "n", "doc_id").join(roots, "node", "left").select("node", "n", "doc_id", F.coalesce("root", "node").alias("root")), "roots")
    least = stage(at.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    at = at.join(least, "root").select("node", "n", "root", "component_id")
    key = F.xxhash64("doc_id", "text")
    # a null text has a key of its own, of another length than a digest, so that null texts don't meet in one task
    digest = F.coalesce(F.unhex(F.md5("text")), F.unhex(F.concat(F.lit("00"), F.md5(key.cast("string")))))
    own = docs.select("doc_id", digest.alias("d_node"), F.unhex(F.md5("text")).alias("own_node"), key.alias("key"))
    return own.join(at, F.col("d_node") == F.col("node"), "left").select(
        "doc_id", "key", "root", F.col("own_node").alias("node"), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
