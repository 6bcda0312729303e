"""Benchmark decontamination: hashed test n-grams are broadcast, training token windows scanned, hits verified.

Words are runs of digits, letters a-z and characters outside ASCII, A-Z lower-cased. Each test item gives its windows of
n consecutive words; an item with fewer words is one window. A scan hashes every window of a document, looks the hashes
up in the sorted hashes of the test windows, then compares the words themselves, so a hash collision can't make a hit.

What is broadcast is the items' bytes, the places of their words, and for each different window 64 bits of hash, a place
and its items: it is measured first, and broadcast only while it takes at most BROADCAST_BYTES. The windows of a larger
benchmark stay a table: a Bloom filter over their hashes, of at most 16 MB, picks the windows of documents that may hit,
and those alone are joined with the table. Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import _scan
from tickloom.llm._util import Bloom, ddl, release, stage, whole
from tickloom.shipping import ship

#: Of the built windows: their texts, and WORD_BYTES for each word.
BROADCAST_BYTES, WORD_BYTES = 128 << 20, 40
_TABLE_BITS = 20
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _starts(words: _scan.Words, n: int):
    """(k, hashes, first words, texts) of the windows of each text, by their length k: n, or all words of a shorter text."""
    sizes = np.diff(words.first)
    hashes, at = _scan.windows(words, n)
    if len(at):
        yield n, hashes, at, np.searchsorted(words.first, at, "right") - 1
    for k in np.unique(sizes[(sizes > 0) & (sizes < n)]).tolist():
        own = np.flatnonzero(sizes == k)
        at = words.first[own]
        yield k, _scan.fold(words.hashes, k)[at], at, own


def _gram(words, i: int, k: int) -> bytes:
    return b" ".join(words.buf[s:e].tobytes() for s, e in zip(words.starts[i : i + k].tolist(), words.ends[i : i + k].tolist()))


class Windows:
    """The windows of some test items (id, text), in arrays."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.ids = [i for i, _ in items]
        words = _scan.Words(*_scan.texts(pa.array([t for _, t in items], pa.large_string())), _scan.ALNUM)
        self.by: dict[int, tuple] = {}
        for k, hashes, at, own in _starts(words, n):
            order = np.lexsort((at, hashes))
            hashes, at, own = hashes[order], at[order], own[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = hashes[1:] != hashes[:-1]
            for j in range(k):  # windows of one hash are one window only if their words are the same
                new[1:] |= words.hashes[at[1:] + j] != words.hashes[at[:-1] + j]
            first = np.flatnonzero(new)
            self.by[k] = (hashes[first], at[first].astype(np.int32), np.append(first, len(at)).astype(np.int32), own.astype(np.int32), _bits(hashes))
        self.buf, self.starts, self.ends = words.buf, words.starts, words.ends

    def scan(self, buf: np.ndarray, offsets: np.ndarray):
        """words, and for each text the merged spans of hit words [first, after) and the set of items that occur."""
        words = _scan.Words(buf, offsets, _scan.ALNUM)
        owner = words.docs()
        items: dict[int, set] = {}
        hits, said = [], {}
        for k, (hs, place, first, own, table) in self.by.items():
            h, at = _scan.windows(words, k)
            near = np.flatnonzero(table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(hs, h[near]), np.searchsorted(hs, h[near], "right")
            some = np.flatnonzero(high > low)
            for i, a, b in zip(at[near[some]].tolist(), low[some].tolist(), high[some].tolist()):
                gram = _gram(words, i, k)
                for w in range(a, b):
                    if (k, w) not in said:
                        said[k, w] = _gram(self, int(place[w]), k)
                    if said[k, w] == gram:
                        hits.append((i, k))
                        found = items.setdefault(int(owner[i]), set())
                        found.update(x for x in map(self.ids.__getitem__, own[first[w] : first[w + 1]].tolist()) if x is not None)
        spans: dict[int, list[list[int]]] = {}
        for i, k in sorted(hits):
            d = int(owner[i])
            i -= int(words.first[d])
            mine = spans.setdefault(d, [])
            if mine and i <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], i + k)
            else:
                mine.append([i, i + k])
        return words, spans, items


def _bits(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return table


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))


def _spans(spans, rows: int) -> pa.Array:
    return pa.array([[{"first": a, "after": b} for a, b in spans.get(d, ())] for d in range(rows)], _SPANS)


#: Arrow's names of the types that item ids keep; ids of others become strings.
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


def _items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    item = F.col(f"`{item_col}`")
    if bench.select(item).schema[0].dataType.simpleString() not in _ARROW:
        item = item.cast("string")
    return bench.select(item.alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()


def _small(items: DataFrame, n: int) -> Windows | None:
    """The windows, if they take no more than may be broadcast."""
    size = F.octet_length("text") + F.size(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).cast("long") * WORD_BYTES
    if (items.agg(F.sum(size)).first()[0] or 0) > BROADCAST_BYTES:
        return None
    return Windows([(r["item"], r.text) for r in items.toLocalIterator()], n)


def _mapped(docs: DataFrame, windows: Windows, text_col: str, schema: str, made) -> DataFrame:
    """What made(rows, words, spans, items) says of each slice of docs, in one pass; rows: all columns as a struct."""
    held, at = docs.sparkSession.sparkContext.broadcast(windows), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            for start, length in _scan.cuts(row.field(at)):
                part = row.slice(start, length)
                yield made(part, *held.value.scan(*_scan.texts(part.field(at))))

    return docs.select(whole(docs)).mapInArrow(run, schema)


def _scanned(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> DataFrame:
    """row (all of docs' columns), n_words, spans, items."""
    ship(docs.sparkSession)
    windows, kind = _small(items, n), items.schema["item"].dataType.simpleString()
    if windows is None:
        free, held = _joined(docs, items, n, text_col)
        return free.unionByName(held)

    def made(row, words, spans, found):
        ids = pa.array([sorted(found.get(d, ())) for d in range(len(row))], pa.list_(_ARROW[kind]))
        return pa.RecordBatch.from_arrays([row, pa.array(np.diff(words.first), pa.int64()), _spans(spans, len(row)), ids], ["row", "n_words", "spans", "items"])

    schema = f"{ddl(docs.select(whole(docs)))}, n_words long, spans array<struct<first:int,after:int>>, items array<{kind}>"
    return _mapped(docs, windows, text_col, schema, made)


def _windows_table(items: DataFrame, n: int) -> DataFrame:
    """h, k, gram, item of all windows, each once."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                words = _scan.Words(*_scan.texts(part.column("text")), _scan.ALNUM)
                for k, h, at, own in _starts(words, n):
                    grams = pa.array([_gram(words, i, k) for i in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([k] * len(at), pa.int32()), grams, part.column("item").take(pa.array(own))], ["h", "k", "gram", "item"])
        release()

    return stage(items.mapInArrow(run, f"h long, k int, gram binary, item {kind}").distinct(), "windows")


def _joined(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The same by a join of windows, as (rows that can't have hits, the others). Equal texts are joined once; texts
    aren't moved, but for those that hit."""
    kind = items.schema["item"].dataType.simpleString()
    table = _windows_table(items, n)
    lengths = sorted(r.k for r in table.select("k").distinct().collect())  # n of them at most
    may = Bloom(table.select("h").distinct(), "h")
    near = may.test()
    text = F.col(f"`{text_col}`").cast("string")

    def candidates(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                words = _scan.Words(*_scan.texts(part.column("text")), _scan.ALNUM)
                owner = words.docs()
                for k in lengths:
                    h, at = _scan.windows(words, k)
                    some = np.flatnonzero(near(h.view(np.int64)))
                    at = at[some]
                    own = owner[at]
                    grams = pa.array([_gram(words, i, k) for i in at.tolist()], pa.binary())
                    first = pa.array((at - words.first[own]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(own)), first, pa.array([k] * len(at), pa.int32()), pa.array(h[some].view(np.int64)), grams], ["node", "first", "k", "h", "gram"])
        release()

    found = docs.where(text.isNotNull()).select(F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    found = found.mapInArrow(candidates, "node binary, first int, k int, h long, gram binary").distinct()
    hits = stage(found.join(table, ["h", "k", "gram"]).select("node", "first", (F.col("first") + F.col("k")).alias("after"), "item"), "hits")
    # spans that touch are one: a new one begins where none before reaches; windows hold one text's hits
    order = Window.partitionBy("node").orderBy("first", "after").rowsBetween(Window.unboundedPreceding, -1)
    places = hits.select("node", "first", "after").distinct().withColumn("new", F.coalesce(F.col("first") > F.max("after").over(order), F.lit(True)).cast("int"))
    places = places.withColumn("span", F.sum("new").over(Window.partitionBy("node").orderBy("first", "after").rowsBetween(Window.unboundedPreceding, 0)))
    spans = places.groupBy("node", "span").agg(F.min("first").alias("first"), F.max("after").alias("after")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("first", "after"))).alias("spans"))
    ids = hits.groupBy(F.col("node").alias("i_node")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = stage(spans.join(ids, F.col("node") == F.col("i_node")).select(F.col("node").alias("h_node"), F.xxhash64("node").alias("key"), "spans", "items"), "hits")
    asked = Bloom(hits, "key").test()
    may.unpersist()
    at = docs.columns.index(text_col)
    rows = docs.select(whole(docs), F.unhex(F.md5(text)).alias("node")).withColumn("key", F.xxhash64("node"))

    def counted(batches):
        for batch in batches:
            column = batch.column("row").field(at)
            for start, length in _scan.cuts(column):
                words = _scan.Words(*_scan.texts(column.slice(start, length)), _scan.ALNUM)
                part = batch.slice(start, length)
                mine = asked(part.column("key").to_numpy())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(words.first), pa.int64()), pa.array(mine)], [*part.schema.names, "n_words", "asked"])

    rows = rows.mapInArrow(counted, f"{ddl(rows)}, n_words long, asked boolean")
    none = [F.expr("cast(array() as array<struct<first:int,after:int>>)").alias("spans"), F.expr(f"cast(array() as array<{kind}>)").alias("items")]
    free = rows.where("NOT asked").select("row", "n_words", *none)
    held = rows.where("asked").join(hits.drop("key"), F.col("node") == F.col("h_node"), "left")
    return free, held.select("row", "n_words", *[F.coalesce(x, y).alias(x) for x, y in zip(("spans", "items"), none)])


def scan(docs: DataFrame, bench: DataFrame, *, n: int = 13, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """docs with n_words, spans (hit words as [first, after), in order, apart from each other) and items (ids, sorted).

    A null text has no words. Repeated test items count once; a null item id makes hits but is not listed. Columns of
    docs named n_words, spans or items are replaced; any other name may be there. Texts of any length are scanned whole;
    repeated rows come out as often as they went in. Empty tables give no hits.
    """
    found = _scanned(docs, _items(bench, item_col, bench_text_col), n, text_col)
    own = ("n_words", "spans", "items")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


def hit_words() -> F.Column:
    return F.expr("aggregate(spans, 0L, (a, x) -> a + x.after - x.first)")


def contaminated(one_in: int = 20) -> F.Column:
    """More than none, and at least one in so many, of a document's words are hit."""
    return (hit_words() > 0) & (one_in * hit_words() >= F.col("n_words"))


def report(docs: DataFrame, bench: DataFrame, *, n: int = 13, one_in: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), bench, n=n)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), contaminated(one_in).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, n: int = 13, one_in: int = 20, length_col: str | None = "n_chars") -> DataFrame:
    """docs without contaminated documents; in the others the spans of hit words are cut from the text.

    A document without hits comes through untouched, whatever its columns are called. Where a text is cut, length_col,
    if there, becomes its new length.
    """
    ship(docs.sparkSession)
    items, names = _items(bench, "item_id", "text"), docs.columns
    windows = _small(items, n)

    def kept(row, spans):
        part = pa.RecordBatch.from_arrays([row.field(i) for i in range(len(names))], names)
        return _cut_rows(part, spans, length_col) if any(spans) else part

    if windows is not None:

        def made(row, words, spans, _):
            own = [[tuple(s) for s in spans.get(d, ())] for d in range(len(row))]
            hits = np.array([sum(b - a for a, b in s) for s in own], dtype=np.int64)
            keep = np.flatnonzero((hits == 0) | (one_in * hits < np.diff(words.first)))
            return kept(row.take(pa.array(keep)), [own[i] for i in keep.tolist()])

        return _mapped(docs, windows, "text", ddl(docs), made)
    free, held = _joined(docs, items, n, "text")

    def run(batches):
        for batch in batches:
            for start, length in _scan.cuts(batch.column("row").field(names.index("text"))):
                part = batch.slice(start, length)
                yield kept(part.column("row"), [[(s["first"], s["after"]) for s in own] for own in part.column("spans").to_pylist()])

    return free.select("row.*").unionByName(held.where(~contaminated(one_in)).select("row", "spans").mapInArrow(run, ddl(docs)))


def _cut_rows(part: pa.RecordBatch, spans: list[list[tuple[int, int]]], length_col: str | None) -> pa.RecordBatch:
    raw = part.column("text").to_pylist()
    lengths = part.column(length_col).to_pylist() if length_col in part.schema.names else None
    for i, own in enumerate(spans):
        if own:
            raw[i] = cut(raw[i], own)
            if lengths:
                lengths[i] = len(raw[i])
    for name, values in (("text", raw), (length_col, lengths)):
        if values is not None:
            at = part.schema.get_field_index(name)
            part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
    return part


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without those words and what stands between them."""
    raw = text.encode()
    words = _scan.Words(*_scan.texts(pa.array([text])), _scan.ALNUM)
    out, at = [], 0
    for first, after in spans:
        out.append(raw[at : words.starts[first]])
        at = int(words.ends[after - 1])
    return b"".join([*out, raw[at:]]).decode()
