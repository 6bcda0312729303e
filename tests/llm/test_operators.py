"""Each operator against a plain version, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from tickloom.llm import chat_format, decontaminate, langid, media, mixing, ngram_join, oracles, queries, sharding, sstable, tokens, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+").findall
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and wordless texts, copies, near copies, a repeated row, a null id, a very long word and text."""
    base = words(120, 1)
    near = base.replace(" w", " W", 3) + " tail"
    far = words(120, 2)
    rows = [(5, base, "a"), (3, base, "b"), (9, near, None), (1, far, "a"), (1, far, "a"), (None, words(30, 3), "c"), (7, None, None), (8, "", "a"), (10, " \n\t", "b"), (11, "one two", "b"), (12, "ONE two", "a"), (13, "é" * 3000 + " ñ. x", "a"), (14, words(20_000, 4), "b"), (15, "x" * 1_200_000, "c")]
    return docs_of(spark, rows).persist()


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(oracles.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def plain_join(rows, k=4, percent=85):
    sets = []
    for _, t, _ in rows:
        w = SPACED((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                up[find(i)] = find(j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        out.append((min(ids) if ids else d, d, len(sets[i])))
    return out


def test_ngram_join_on_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = ngram_join.ngram_join(odd.withColumn("node", F.lit(1)).withColumn("component_id", F.lit(2))).toPandas()
    assert rows_of(got) == sorted(plain_join(rows), key=repr)
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def test_ngram_join_large_group_in_tiles(spark, monkeypatch):
    """A group of near copies larger than a tile, and documents that share one passage alone."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 8)
    base, passage = words(60, 7).split(), words(60, 8)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(50):
        w = list(base)
        for j in rng.integers(0, 60, int(rng.integers(0, 4))):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w), "s"))
    rows += [(100 + i, words(80, 100 + i) + " " + passage, "s") for i in range(30)]
    got = ngram_join.ngram_join(docs_of(spark, rows)).toPandas()
    assert rows_of(got) == sorted(plain_join(rows), key=repr)


def test_deduplicate_keeps_one_of_each_group(spark, odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = ngram_join.deduplicate(odd.withColumn("row", F.lit("x")))
    assert got.columns == [*odd.columns, "row"]
    groups = {c for c, d, n in plain_join(rows) if n}
    kept = [(r.doc_id, r.text) for r in got.collect()]
    with_words = [d for d, t in kept if SPACED(t or "")]
    assert sorted(with_words, key=repr) == sorted(groups, key=repr)
    assert len(kept) - len(with_words) == 3


def test_deduplicate_with_null_and_shared_ids(spark):
    """Documents that aren't linked all stay, though their ids are null or the same; linked ones leave one."""
    a, b, c, d, e = (words(100, i) for i in range(40, 45))
    rows = [(None, a, "s"), (None, a + " tail", "s"), (None, b, "s"), (None, b, "s"), (4, c, "s"), (4, d, "s"), (6, e, "s"), (6, e + " tail", "s"), (None, e + " end", "s")]
    kept = [(r.doc_id, " ".join(r.text.split()[:100])) for r in ngram_join.deduplicate(docs_of(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(None, a), (None, b), (4, c), (4, d), (6, e)], key=repr)


def plain_hits(rows, bench, n=13):
    items = [(i, ALNUM((t or "").translate(LOWER))) for i, t in bench]
    out = []
    for d, t, _ in rows:
        w = ALNUM((t or "").translate(LOWER))
        hit, ids = set(), set()
        for item, b in items:
            k = min(n, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    if item is not None:
                        ids.add(str(item))
        out.append((len(hit) > 0 and 20 * len(hit) >= len(w), d, hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit), len(ids), len(w)))
    return out


def test_decontamination_on_odd_rows(spark, odd):
    long = odd.where("doc_id = 14").first().text
    bench = [(2, words(120, 1)), (10, "ONE, two"), (11, long[5000:5200]), (None, "é" * 3000), (12, None), (13, "!!"), (2, "ñ")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    want = sorted(plain_hits(rows, bench), key=repr)
    assert rows_of(decontaminate.report(odd.withColumn("items", F.lit(1)), table).toPandas()) == want
    assert decontaminate.report(empty(spark), table).count() == 0
    assert decontaminate.report(odd, table.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_by_join(spark, odd, monkeypatch):
    """A benchmark above the bound is joined, with the same rows, whatever the documents' columns are called."""
    bench = [(i, words(120, i)) for i in range(1, 5)] + [(9, "one two"), (None, words(40, 1)), (8, words(40, 1))]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    clash = odd.withColumns({"n_words": F.lit(-7), "spans": F.lit("s"), "items": F.lit(1.5), "hit_key": F.lit("k"), "node": F.lit(1), "row": F.lit(2), "key": F.lit("z"), "asked": F.lit(3)})
    for ids in (bench, [(i and f"item {i}", t) for i, t in bench]):
        table = spark.createDataFrame(ids, f"item_id {'long' if ids is bench else 'string'}, text string")
        got = []
        for most in (1 << 27, 700):
            monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
            assert rows_of(decontaminate.report(odd, table).toPandas()) == sorted(plain_hits(rows, ids), key=repr)
            assert decontaminate.scan(clash, table).columns == ["doc_id", "text", "lang", "source", "n_chars", "hit_key", "node", "row", "key", "asked", "n_words", "spans", "items"]
            kept = decontaminate.decontaminate(clash, table)
            assert kept.columns == clash.columns
            got.append((sorted(map(repr, decontaminate.scan(clash, table).collect())), sorted(map(repr, kept.collect()))))
        assert got[0] == got[1] and all("n_words=-7" in r for r in got[0][1])


def test_windows_take_few_bytes():
    """Built windows take what is reckoned for them, a small multiple of their text."""
    text = words(200_000, 3)
    built = decontaminate.Windows([(1, text)], 13)
    arrays = [built.buf, built.starts, built.ends, *[a for t in built.by.values() for a in t]]
    assert sum(a.nbytes for a in arrays) <= len(text) + 200_000 * decontaminate.WORD_BYTES + 13 * (1 << 20)


def test_decontaminate_cuts_or_drops(spark):
    passage, clean = words(20, 5), words(900, 6)
    docs = docs_of(spark, [(1, passage, "a"), (2, clean, "a"), (3, f"{clean[:2000]} {passage}. {clean[2000:]}", "a")])
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert sorted(got) == [2, 3] and got[2].text == clean
    assert got[3].text == f"{clean[:2000]} . {clean[2000:]}" and got[3].n_chars == len(got[3].text)


def test_kd_shards(spark, odd):
    for d in (odd, spark.read.parquet(f"{DATA}/documents.parquet")):
        got = sharding.kd_shards(d, shards=4).toPandas()
        assert len(got) == d.count() and set(got["law"]) == {"bytes"}
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 4 and sums.max() - sums.min() <= 2 * got["size"].max()
    assert sharding.kd_shards(empty(spark)).count() == 0
    by_bytes = sharding.kd_shards(d, target_bytes=100_000).toPandas().groupby("shard")["size"].sum()
    assert by_bytes.max() < 100_000 + got["size"].max()
    hot = docs_of(spark, [(i, "same text", "one") for i in range(300)])
    assert sharding.kd_shards(hot, shards=3).groupBy("shard").count().toPandas()["count"].tolist() == [100, 100, 100]


def test_kd_shards_against_a_plain_tree(spark):
    """The same cuts as a tree over all rows' codes in memory, and odd ids: hashed, far off, null, strings."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for ids in ("doc_id", "xxhash64(doc_id)", "if(doc_id = 7, 9000000000000000000, doc_id)", "if(doc_id % 3 = 0, null, doc_id)", "concat('id ', doc_id)", "cast(doc_id / 7 as double)"):
        d = docs.withColumn("doc_id", F.expr(ids)).withColumns({"shard": F.lit("x"), "slot": F.lit(1), "part": F.lit(2)})
        got = sharding.kd_shards(d, shards=5).toPandas()
        sums = got.groupby("shard")["size"].sum()
        assert len(got) == docs.count() and len(sums) == 5 and sums.max() - sums.min() <= 2 * got["size"].max()
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
    rng = np.random.default_rng(4)
    codes = [(int(a), int(b)) for a, b in rng.integers(0, 1 << 62, (500, 2))]
    rows = spark.createDataFrame([(list(c), 1) for c in codes], "codes array<long>, w long")
    tree = sharding.plan(rows, 2, "w", 6, 500)

    def cells(own, shards, box):
        if shards == 1:
            return [sorted(own)]
        d = max((0, 1), key=lambda d: (box[d][1] - box[d][0], -d))
        by = sorted(own, key=lambda c: c[d])
        at = len(by) * (shards // 2) // shards
        cut = by[at][d]
        left, right = [c for c in own if c[d] < cut], [c for c in own if c[d] >= cut]
        low, high = list(box), list(box)
        # any cut between two neighbours splits the rows alike, so the boxes are taken from the tree's own
        node = nodes.pop(0)
        low[d], high[d] = (box[d][0], tree.cut[node]), (tree.cut[node], box[d][1])
        nodes[:0] = [2 * node] if shards // 2 > 1 else []
        a = cells(left, shards // 2, low)
        nodes[:0] = [2 * node + 1] if shards - shards // 2 > 1 else []
        return a + cells(right, shards - shards // 2, high)

    nodes = [1]
    want = cells(codes, 6, [(0, 1 << 62)] * 2)
    first = {i: n for i, n in tree.first.items() if tree.count[i] == 1}
    found = {}
    for r in rows.select("codes", tree.node_of().alias("node")).collect():
        found.setdefault(first[r.node], []).append(tuple(r.codes))
    sizes = [len(found[i]) for i in range(6)]
    assert max(abs(len(w) - n) for w, n in zip(want, sizes)) <= 2 and sum(sizes) == 500


def test_kd_shards_many_shards(spark, monkeypatch):
    """More shards than histograms are collected for; hot values; a target of bytes."""
    docs = docs_of(spark, [(i, "x" * (i % 40), "hot" if i % 3 else f"s{i}") for i in range(4000)])
    monkeypatch.setattr(sharding, "WIDE", 8)
    got = sharding.kd_shards(docs, shards=64).toPandas().groupby("shard")["size"].sum()
    assert len(got) == 64 and got.max() - got.min() <= 3 * 48
    monkeypatch.setattr(sharding, "HISTOGRAM_ROWS", 2048)
    assert sharding.kd_shards(docs, shards=1500).select("shard").distinct().count() > 1450


def test_kd_numbered_in_parts(spark):
    placed = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").alias("size"), F.col("id").alias("text_crc32"), F.xxhash64("id").alias("salt"), (F.col("id") % 3).cast("int").alias("shard"))
    got = sharding.numbered(placed, 3000, 3, rows_each=100).toPandas()
    assert all(sorted(g["slot"]) == list(range(1000)) for _, g in got.groupby("shard")) and got["part"].nunique() == 10


def test_ids_of_other_types(spark):
    """Operators take ids as they are: strings keep their type and give the same rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = docs.withColumn("doc_id", F.format_string("id %09d", "doc_id"))
    name = lambda x: f"id {x:09d}"
    a, b = ngram_join.ngram_join(docs).toPandas(), ngram_join.ngram_join(text).toPandas()
    for c in ("doc_id", "component_id"):
        a[c] = a[c].map(name)
    assert rows_of(a) == rows_of(b)
    a, b = media.features(media.store(docs)).toPandas(), media.features(media.store(text)).toPandas()
    assert rows_of(a.assign(doc_id=a["doc_id"].map(name))) == rows_of(b)
    assert mixing.taken(text).toPandas()["doc_id"].str.startswith("id ").all()
    e = lambda d, ids: rows_of(sstable.digest(spark, sstable.write(d, spec(), shards=3), ids).toPandas())
    assert [(name(r[0]), *r[1:]) for r in sorted(e(docs, "long"))] == sorted(e(text, "string"))
    assert sorted(sstable.lookup(sstable.write(text, spec()), [name(3), "id none"])) == [name(3)]


def test_mixing(spark, odd):
    rows = [(i, words(5 + i % 7, i), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    for d in (docs_of(spark, rows), odd):
        got = mixing.taken(d).toPandas()
        assert len(got) == d.count() and (got["taken"] <= 3 * got["size"]).all()
        by = got.groupby(["source_size", "target"])["taken"].sum().reset_index()
        assert ((by["taken"] - by["target"]).abs() <= got["size"].max()).all()
        assert got["taken"].sum() <= got["size"].sum() and rows_of(got) == rows_of(mixing.taken(d.repartition(3)).toPandas())
        applied = mixing.apply(d.withColumn("m_row", F.lit(1)))
        assert applied.columns == [*d.columns, "m_row"]
    d = docs_of(spark, rows)
    want = {r.doc_id: r.taken // r["size"] for r in mixing.taken(d).collect() if r.taken}
    assert {r.doc_id: r["count"] for r in mixing.apply(d).groupBy("doc_id").count().collect()} == want
    assert mixing.mix(d).count() == sum(want.values()) and mixing.taken(empty(spark)).count() == 0 and mixing.apply(empty(spark)).count() == 0


SPEC = None


def spec():
    global SPEC
    SPEC = SPEC or queries.tokenizer_spec()
    return SPEC


def test_encoder_equals_library():
    e = tokens.Encoder(spec(), 5000)
    rng = np.random.default_rng(1)
    parts = [" ", "\n", "a", "é", ".", ",", "'s", "1", "\t", "日", "-", " b", "\x1c", "\xa0", "\u2003", "<|endoftext|>"]
    raw = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)] + [None, "a, b.\nC, d", "\ufeffx y"]
    want = [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in raw]
    assert [x for i in range(0, len(raw), 100) for x in e.encode(raw[i : i + 100])] == want


def test_encoder_equals_library_as_loaded():
    """Strings of added tokens are tokens, as in a freshly loaded tokenizer, wherever they stand in a text."""
    from tokenizers import Tokenizer

    library, e = Tokenizer.from_str(spec()), tokens.Encoder(spec(), 5000)
    rng = np.random.default_rng(2)
    parts = [" ", "\n", "a", "é", ".", "\t", "<|endoftext|>", "<|endof", "text|>"]
    raw = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(1000)] + ["end of a page<|endoftext|>next page", "<|endoftext|>", "a <|endoftext|>\nb", None]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in raw]
    assert len(want[1000]) == 4 * 7 and [x for i in range(0, len(raw), 100) for x in e.encode(raw[i : i + 100])] == want


def test_encoder_gives_new_words_to_the_library_together():
    """op4: as few texts, as the library's time for each is more than that for a word; ids are the library's."""
    e = tokens.Encoder(spec())
    library, given = e.tokenizer, []

    class Counted:
        def encode_batch_fast(self, raw, **options):
            given.extend(raw)
            return library.encode_batch_fast(raw, **options)

    e.tokenizer = Counted()
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice([*"abcdefghéß日1-'"], 9)) + rng.choice(["", ".", ",", "&&&", "!?", "'s", "-."])
    raw = [" ".join(word() for _ in range(300)).replace(" a", "\na") for _ in range(20)]
    assert e.encode(raw) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in raw]
    assert len(given) < 100
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    raw = [" ".join(f"x{c}. {c}&" for c in letters[i : i + 100]) for i in range(0, len(letters), 100)]
    assert e.encode(raw) == [np.array(x.ids, dtype="<u4").tobytes() for x in library.encode_batch_fast(raw, add_special_tokens=False)]


def test_encoder_of_another_family():
    """Texts go whole to a tokenizer that doesn't cut at spaces."""
    from tokenizers import Tokenizer

    other = queries.tokenizer_spec("word_bpe_49k.json")
    assert tokens.cuts_at_spaces(spec()) and not tokens.cuts_at_spaces(other)
    raw = ["Hello  World, a b", "", None, "x\ny <|endoftext|> z"]
    library, e = Tokenizer.from_str(other), tokens.Encoder(other)
    assert e.encode(raw) == [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in raw]


def test_sstable_round_trip(spark, odd):
    manifest = sstable.write(odd, spec(), shards=3)
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec())
    plain = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for d, t in rows:
        ids = plain(t) + b"\x02\0\0\0"
        want.append((d, zlib.crc32(ids), len(ids) // 4, start))
        start += len(ids) // 4
    assert rows_of(sstable.digest(spark, manifest).toPandas()) == sorted(want, key=repr)
    whole = sstable.read(spark, manifest).orderBy("start").collect()
    assert [zlib.crc32(r.ids) for r in whole] == [w[1] for w in want]
    found = sstable.lookup(manifest, [1, 14, 999])
    assert sorted(found) == [1, 14] and len(found[1]) == 2 and found[14][0][-1] == 2
    assert sstable.digest(spark, sstable.write(empty(spark), spec())).count() == 0


def test_sstable_notices_damage(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.sst")
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i in range(5000):
            w.add(sstable.key_of(i * 3), np.arange(i % 50))
        w.close()
    local = fs.LocalFileSystem()
    r = sstable.Reader(local.open_input_file(path))
    assert len(r.index) > 1 and r.get(sstable.key_of(30))[0].tolist() == list(range(10)) and r.get(sstable.key_of(31)) == []
    raw = bytearray(open(path, "rb").read())
    raw[100] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(sstable.Reader(local.open_input_file(path)))


def test_url_rules(spark):
    rng = np.random.default_rng(2)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "a.com", ".com", ""]
    urls = [None, "no scheme", "http://", "x://?q", "HTTP://A.Example.ORG/es/1#x", "http://example.org?x/es/"] + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es/x', '/en/12', '/fr/?a', '/de/#b'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [*queries.URL_RULES, ("Example.org", "/es/x", "allow"), ("", "/", "block"), (None, "/", "block"), ("a.example.org", "", "block"), ("org", "/es/", "allow"), ("org", "/es/", "block")]

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host, best = host.translate(LOWER), None
        for h, p, v in sorted(r for r in rules if r[0]):
            h = h.translate(LOWER)
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                new = (len(h) + len(p), len(h))
                if best is None or new > best[0]:
                    best = (new, h + p, v)
        return (host, path, best[1] if best else None, best[2] if best else "allow")

    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(((h, i if i % 50 else None, p, r, v) for i, u in enumerate(urls) for h, p, r, v in [plain(u)]), key=repr)
    assert rows_of(url_rules.judge(pages, table, partitions=3).toPandas()) == want
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert url_rules.judge(pages, table.limit(0)).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_url_rules_in_parts(spark, monkeypatch):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = rows_of(url_rules.judge(pages, rules).toPandas())
    monkeypatch.setattr(url_rules, "BROADCAST_BYTES", 40)
    assert rows_of(url_rules.judge(pages, rules).toPandas()) == want


def test_media_reads_with_one_worker(spark, odd):
    """op6: a task has one Python worker for the header's read and the whole one, which are still two reads."""
    cat = media.store(odd)
    assert media.features(cat)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    stored, asked = media.encode(media.payload("text")), []

    def read(n, offset):
        asked.append((n, offset))
        return stored[offset - 7 : offset - 7 + n]

    assert media._head(read, 7, len(stored)) == [576, 1, 8, 0] and asked == [(media.HEADER_BYTES, 7)]


def test_media(spark, odd):
    cat = media.store(odd)
    got = media.features(cat).toPandas()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for d, t in texts for p in [media.payload(t)]), key=repr)
    assert rows_of(got[["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]]) == sorted(((d, n, b, s, c)[:1] + (n, b, s, c) for d, n, b, s, c in want), key=repr)
    def plain(p):
        rows = b"".join(b"\0" + p[i : i + 576] for i in range(0, len(p), 576))
        chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (576).to_bytes(4, "big") + (len(p) // 576).to_bytes(4, "big") + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
        share = [p.count(bytes([v])) / len(p) for v in set(p)]
        return len(png), hashlib.sha256(png).hexdigest(), f"png 576x{len(p) // 576} depth=8 sum={sum(p)} values={len(share)} entropy={-sum(x * np.log2(x) for x in share) + 0.0:.6f}", 576, len(p) // 576

    for r in got.itertuples():
        t = dict(texts).get(None if r.doc_id != r.doc_id else int(r.doc_id))
        raw = (t or "").encode()
        size, digest, feature, width, height = plain(raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw)))
        assert (r.media_bytes, r.media_sha256, r.width, r.height) == (size, digest, width, height) and r.feature.replace("-0.000000", "0.000000") == feature
    assert cat.where("stored").count() < cat.count()  # copies are stored once
    one = got[got["doc_id"].isin([3, 5])]
    assert one["feature"].nunique() == one["media_sha256"].nunique() == 1
    head = media.metadata(cat).toPandas()
    assert (head["width"] == media.SIDE).all() and (head["bit_depth"] == 8).all()
    assert media.canonical(cat).count() == cat.select("digest").distinct().count()
    assert media.store(empty(spark)).count() == 0
    import tarfile

    row = cat.first()
    with tarfile.open(row.shard.removeprefix("file://").removeprefix("file:")) as t:
        member = t.getmember(f"{row.digest}.png")
        assert media.decode(t.extractfile(member).read()) and member.offset_data == row.offset
    with pytest.raises(ValueError):
        media.header(b"GIF" + bytes(40))


def test_language_held_out(spark, odd):
    out = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.98 and 0 <= held[1] and held[2] <= 1
    model = langid.fit(odd)
    got = {r.doc_id: r for r in langid.predict(odd.withColumn("score", F.lit("x")), model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {7, 8, 10} and got[13].lang_pred == "en"
    assert langid.predict(odd, langid.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty(spark), model).count() == 0


def test_language_sample_with_hot_copies(spark):
    """The sample is of about per_language different texts, however often some of them are repeated."""
    name = lambda k, i: k + "".join(chr(97 + int(c)) for c in f"{i:03d}")
    rows = [("x", f"{w} {w}") for w in ["hotx"] * 5000 + [name("x", i) for i in range(200)]]
    rows += [("y", f"{w} {w}") for w in [name("y", i) for i in range(3)] * 1000]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), per_language=40)
    learnt = [w for w in model["words"]["keys"] if w != "hotx"]
    assert 20 <= sum(w[0] == "x" for w in learnt) <= 70 and sum(w[0] == "y" for w in learnt) == 3


def test_many_languages(spark):
    """However many there are, each is learnt and can be predicted."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    rows = [(f"l{i:04d}", f"zz{name(i)}q zz{name(i)}q xx{name(i)}") for i in range(600)]
    train = spark.createDataFrame(rows, "lang string, text string")
    got = langid.predict(train, langid.fit(train)).toPandas()
    assert (got["lang"] == got["lang_pred"]).all()


def test_language_against_a_plain_version(spark):
    """Frequencies counted and added up one by one, over the same (whole, as it is small) sample."""
    from collections import Counter
    from math import exp, log, sqrt

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    rows = [(r.lang, r.text) for r in docs.collect()]
    langs = sorted({x for x, t in rows if x is not None and t is not None})
    find = re.compile(r"[^\W\d_]+").findall
    counts, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for x, t in {(x, t) for x, t in rows if x is not None and t is not None}:
        for w in find(t.lower()):
            counts[x][w] += 1
            for n in range(1, 5):
                grams[x].update(f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n))
    total = sum(counts.values(), Counter())
    known, pieces = {w for w, c in total.items() if c >= 2}, set(sum(grams.values(), Counter()))

    def scale(table, keys):
        return {x: sum(c for g, c in table[x].items() if g in keys) + 0.5 * (len(keys) + 1) for x in langs}

    sums, gram_sums = scale(counts, known), scale(grams, pieces)

    def plain(text):
        words = find((text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        add = dict.fromkeys(langs, 0.0)
        for w in words:
            for x in langs:
                if w in known:
                    add[x] += log((counts[x][w] + 0.5) / sums[x])
                    continue
                p = f"^{w}$"
                for end in range(2, len(p) + 1):
                    g = next((p[end - n : end] for n in range(min(4, end), 0, -1) if p[end - n : end] in pieces), None)
                    add[x] += log(((grams[x][g] if g else 0) + 0.5) / gram_sums[x])
        best = max(langs, key=lambda x: add[x])
        return best, 1 / sum(exp((add[x] - add[best]) / sqrt(len(words))) for x in langs)

    extra = docs_of(spark, [(-1, "½ Ⅷ", "a"), (-2, "ΟΔΟΣ İstanbul ſs zzzxxq", "a"), (-3, "12 !", "a"), (-4, None, "a")])
    got = langid.predict(docs.limit(60).unionByName(extra.select(docs.columns)), model).collect()
    for r in got:
        lang, score = plain(r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, (r.doc_id, lang, score)


def test_toxicity_against_a_plain_version(spark):
    """Weights by the update rule, one coordinate at a time, over the same features; then scores."""
    from math import exp, sqrt

    texts = ["you are vile and nasty", "a fine day for all", "vile vile words", "all is fine", "", None]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts * 30)])
    labels = spark.createDataFrame([(i, int("vile" in (t or ""))) for i, t in enumerate(texts * 30)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, epochs=2)

    def features(t):
        import pyarrow as pa

        _, at, _ = toxicity._features(pa.array([t]))
        w = ALNUM((t or "").translate(LOWER))
        assert len(at) == len(w) + max(0, len(w) - 1) + max(0, len(w) - 2)
        assert len(set(at.tolist())) == len({(x,) for x in w} | {(x, y, 1) for x, y in zip(w, w[1:])} | {(x, y, 2) for x, y in zip(w, w[2:])})
        return sorted(set(at.tolist()))

    order = [(r.doc_id, texts[r.doc_id % 6]) for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == "bias" else toxicity.L1
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - (1 if v > 0 else -1) * l1) / ((toxicity.BETA + sqrt(n.get(k, 0.0))) / toxicity.RATE + toxicity.L2)

    for _ in range(2):
        for _, t in order:
            own = [*features(t), "bias"]
            w = {k: weight(k) for k in own}
            g = 1 / (1 + exp(-sum(w.values()))) - int("vile" in (t or ""))
            for k in own:
                sigma = (sqrt(n.get(k, 0.0) + g * g) - sqrt(n.get(k, 0.0))) / toxicity.RATE
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    assert sorted(model[0].tolist()) == sorted(k for k in z if k != "bias" and abs(z[k]) > toxicity.L1)
    for r in toxicity.predict(docs, model).limit(12).collect():
        want = 1 / (1 + exp(-sum(weight(k) for k in [*features(r.text), "bias"])))
        assert abs(r.score - want) < 1e-5


def test_toxicity_held_out(spark, odd):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(1500):
        w = words(60, i).split()
        bad = i % 4 == 0
        if bad:
            for j in rng.integers(0, 60, 3):
                w[j] = rng.choice(["vile", "horrid", "nasty"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    docs = docs_of(spark, rows)
    table = spark.createDataFrame([*labels, (1, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table.where("doc_id % 3 <> 1 OR doc_id IS NULL"))
    assert len(model[0]) < 1000
    got = toxicity.predict(docs, model).where("doc_id % 3 = 1").withColumn("y", (F.col("doc_id") % 4 == 0).cast("int"))
    r = got.groupBy("y").agg(F.avg((F.col("score") >= 0.7).cast("int")).alias("p")).collect()
    assert {x.y: x.p for x in r}[1] > 0.95 and {x.y: x.p for x in r}[0] < 0.02
    scores = toxicity.predict(odd.withColumn("score", F.lit("x")), model).select("score").toPandas()["score"]
    assert len(scores) == odd.count() and scores.between(0, 1).all() and toxicity.predict(empty(spark), model).count() == 0
    flat = toxicity.fit(empty(spark), table)
    assert len(flat[0]) == 0 and toxicity.predict(odd, flat).where("score <> 0.5").count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi {x}"), (1, 1, "tool", '{"tool_call_id":"b","content":{"z":1,"a":[2]}}'), (1, 2, "assistant", '{"content":"ok","tool_calls":[{"id":"a","name":"f","arguments":{"y":"s","x":3}},{"id":"b","name":"g","arguments":{}}]}'), (1, 3, "tool", '{"tool_call_id":"a","content":"fine"}'), (1, 4, "tool", '{"tool_call_id":"q","content":"?"}'), (1, 5, "assistant", "{not json"), (None, None, None, None), (2, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":"no"}},{"id":"a","name":"h","arguments":[1]}]}'), (2, 1, "tool", '{"tool_call_id":"a","content":1}'), (2, 1, "tool", '{"tool_call_id":"a","content":1}')]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("f", "x", "integer", True), ("f", "y", "string", False), ("g", "k", "string", True)], "name string, parameter string, type string, required boolean")
    got = chat_format.format_chat(t, tools).orderBy("conv_id", "seq").collect()
    one = [(r.kind, r.call_id, r.linked, r.problem) for r in got if r.conv_id == 1]
    assert one == [("message", None, None, ""), ("message", None, None, ""), ("call", "a", True, ""), ("call", "b", True, "missing: k"), ("result", "b", True, ""), ("result", "a", True, ""), ("result", "q", False, "no call"), ("message", None, None, "")]
    assert [r.json for r in got if r.call_id == "a" and r.conv_id == 1][0] == '{"arguments":{"x":3,"y":"s"},"call_id":"a","kind":"call","name":"f","role":"assistant","turn":2}'
    two = [(r.kind, r.problem) for r in got if r.conv_id == 2]
    assert two[1:3] == [("call", "wrong type: x"), ("call", "repeated id")] and [k for k, _ in two].count("result") == 2
    assert [r.json for r in got if r.conv_id is None] == ['{"kind":"message"}'] and [r.seq for r in got if r.conv_id == 1] == list(range(8))
    assert chat_format.format_chat(t.limit(0)).count() == 0


def test_chat_shapes(spark):
    """Both shapes of a call, arguments as text or not, and fields that aren't known."""
    import json

    calls = [{"id": "a", "type": "function", "function": {"name": "f", "arguments": '{"x": 1}', "strict": True}}, {"id": "b", "name": "g", "arguments": {"k": "v"}, "note": [1]}, {"id": "c", "function": {"name": "f", "arguments": "{bad"}}, "odd", {"id": "d", "function": "f"}]
    rows = [(1, 0, "assistant", json.dumps({"content": [{"type": "text"}], "tool_calls": calls, "model": "m"})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": None, "name": "f"})), (1, 2, "assistant", json.dumps({"content": "x", "tool_calls": []}))]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("f", "x", "integer", True), ("g", "k", "string", True)], "name string, parameter string, type string, required boolean")
    got = [(json.loads(r.json), r.problem) for r in chat_format.format_chat(t, tools).orderBy("seq").collect()]
    m, a, b, c, odd, d, result, last = got
    assert m[0] == {"extra": {"content": [{"type": "text"}], "model": "m"}, "kind": "message", "role": "assistant", "turn": 0}
    assert a == ({"arguments": {"x": 1}, "call_id": "a", "extra": {"function.strict": True, "type": "function"}, "kind": "call", "name": "f", "role": "assistant", "turn": 0}, "")
    assert (b[0]["arguments"], b[0]["extra"], b[1]) == ({"k": "v"}, {"note": [1]}, "")
    assert (c[0]["arguments"], c[1]) == ("{bad", "arguments are no object") and odd[0]["arguments"] == "odd" and d[0]["extra"] == {"function": "f"}
    assert result[0] == {"call_id": "a", "extra": {"name": "f"}, "kind": "result", "result": None, "role": "tool", "turn": 1} and last[0]["content"] == "x"


def test_chat_against_a_plain_version(spark, monkeypatch):
    """Random conversations: linking, order and checks by plain loops, with and without crowded ranges."""
    import json

    rng = np.random.default_rng(11)
    rows = []
    for conv in (1, 2, None):
        for _ in range(60):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 12))
            kind = rng.integers(0, 4)
            if kind == 0:
                rows.append((conv, turn, "user", f"hi {rng.integers(0, 5)}"))
            elif kind == 1:
                made = [{"id": f"c{rng.integers(0, 15)}", "name": str(rng.choice(["f", "g", "h"])), "arguments": {k: v for k, v in (("x", 1), ("y", "s"), ("z", 2)) if rng.random() < 0.5}} for _ in range(rng.integers(1, 4))]
                rows.append((conv, turn, "assistant", json.dumps({"content": f"t{len(rows)}", "tool_calls": made})))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.integers(0, 18)}", "content": len(rows)})))
    tools = {"f": {"x": ("integer", True), "y": ("string", False)}, "g": {"y": ("integer", False)}}
    low = lambda t: -1 if t is None else t

    def plain(conv):
        lines = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            told = json.loads(text) if role != "user" else None
            if role == "tool":
                lines.append({"kind": "result", "turn": turn, "part": 0, "role": role, "id": told["tool_call_id"], "result": told["content"]})
                continue
            lines.append({"kind": "message", "turn": turn, "part": 0, "role": role, "id": None, "content": told["content"] if told else text})
            for i, x in enumerate(told["tool_calls"] if told else ()):
                lines.append({"kind": "call", "turn": turn, "part": i + 1, "role": role, "id": x["id"], "name": x["name"], "arguments": x["arguments"]})
        place = lambda x: (low(x["turn"]), x["part"])
        first = {k: {} for k in ("call", "result")}
        for x in lines:
            if x["kind"] in first:
                first[x["kind"]][x["id"]] = min(first[x["kind"]].get(x["id"], place(x)), place(x))
        out = []
        for x in lines:
            linked, problem, at = None, "", (*place(x), 0)
            if x["kind"] == "call":
                linked = first["call"][x["id"]] == place(x) and x["id"] in first["result"]
                schema, given = tools.get(x["name"]), x["arguments"]
                if schema is None:
                    problem = "unknown tool"
                else:
                    bad = {"missing": [k for k, (_, need) in schema.items() if need and k not in given], "unknown": [k for k in given if k not in schema], "wrong type": [k for k, v in given.items() if k in schema and schema[k][0] != ("integer" if isinstance(v, int) else "string")]}
                    problem = next((f"{w}: {','.join(sorted(ks))}" for w, ks in bad.items() if ks), "")
                if first["call"][x["id"]] != place(x):
                    problem = "repeated id"
            elif x["kind"] == "result":
                call = first["call"].get(x["id"])
                linked = call is not None and first["result"][x["id"]] == place(x)
                problem = "no call" if call is None else "" if linked else "repeated"
                if call is not None and call > place(x):
                    at = (*call, 1)
            body = {"arguments": x.get("arguments"), "call_id": x["id"], "content": x.get("content"), "kind": x["kind"], "name": x.get("name"), "result": x.get("result"), "role": x["role"], "turn": x["turn"]}
            said = json.dumps({k: v for k, v in body.items() if v is not None}, sort_keys=True, separators=(",", ":"))
            out.append((at, low(x["turn"]), x["kind"], x["id"] or "", linked, problem, said))
        return sorted(out, key=repr)

    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = spark.createDataFrame([(n, p, k, r) for n, own in tools.items() for p, (k, r) in own.items()], "name string, parameter string, type string, required boolean")
    for crowded in (65_536, 3):
        monkeypatch.setattr(chat_format, "CROWDED", crowded)
        monkeypatch.setattr(chat_format, "TURNS_EACH", 5)
        got = chat_format.format_chat(t, table).collect()
        for conv in (1, 2, None):
            own, want = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.seq), plain(conv)
            assert [r.seq for r in own] == list(range(len(want)))
            assert sorted((r.kind, r.call_id or "", r.linked, r.problem, r.json) for r in own) == sorted(w[2:] for w in want) if all(w[4] is not None for w in want) else sorted(map(repr, ((r.kind, r.call_id or "", r.linked, r.problem, r.json) for r in own))) == sorted(repr(w[2:]) for w in want)
            at = {w[6]: w[:4] for w in want}
            places = [at[r.json] for r in own]
            assert places == sorted(places)
