"""The chain of stages against a plain version of each, and run() against the chain."""

import corpus_pipeline as P
from conftest import DATA, rows_of
from test_operators import docs_of, plain_hits, plain_join, words

from tickloom.llm import mixing, ngram_join, queries, sstable
from tickloom.llm._util import stage


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    a = stage(P.language_id(spark, docs, DATA), "a")
    assert a.columns == columns and a.count() == docs.count()  # all of these have a language
    rows = [(r.doc_id, r.text, r.source) for r in a.collect()]
    b = stage(P.near_duplicates(spark, a, DATA), "b")
    assert b.columns == columns and sorted(r.doc_id for r in b.collect()) == sorted({c for c, d, n in plain_join(rows)})
    rows = [(r.doc_id, r.text, r.source) for r in b.collect()]
    c = stage(P.benchmark_decontamination(spark, b, DATA), "c")
    hits = {h[1]: h for h in plain_hits(rows, bench)}
    kept = {r.doc_id: r.text for r in c.collect()}
    assert c.columns == columns and set(kept) == {d for d, h in hits.items() if not h[0]}
    assert all(kept[d] == t for d, t, _ in rows if d in kept and not hits[d][3])
    d = stage(P.source_mix(spark, c, DATA), "d")
    want = {r.doc_id: r.taken // r["size"] for r in mixing.taken(c).collect() if r.taken}
    assert d.columns == columns and {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()} == want
    e = P.token_output(spark, d, DATA).toPandas()
    assert rows_of(e) == rows_of(sstable.digest(spark, sstable.write(d, queries.tokenizer_spec())).toPandas())
    assert rows_of(P.run(spark, DATA).toPandas()) == rows_of(e)


def test_language_stage_rejects(spark):
    docs = docs_of(spark, [(i, words(50, i) + " the of and", "a") for i in range(30)] + [(90, None, "a"), (91, "", "a"), (92, "123 !!", None)])
    assert sorted(r.doc_id for r in P.language_id(spark, docs, DATA).collect()) == list(range(30))


def test_near_duplicates_by_five_words_and_four_fifths(spark):
    """A copy with a fifth more words: 396/476 of 5-word shingles are common, 397/477 (less than 0.85) of op3's."""
    base = " ".join(f"b{i}" for i in range(400))
    docs = docs_of(spark, [(1, base, "a"), (2, " ".join([base, *(f"f{i}" for i in range(80))]), "a"), (3, words(400, 3), "a")])
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, DATA).collect()) == [1, 3]
    assert sorted(r.component_id for r in ngram_join.ngram_join(docs).collect()) == [1, 2, 3]


def test_stages_are_the_named_ones():
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns, and an empty table."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = (docs.orderBy("doc_id").limit(2).collect()[i].text for i in (0, 1))
    rows = [(1, a, "en", "x", len(a)), (1, a, "en", "x", len(a)), (1, b, None, None, None), (None, b, "en", "x", 1), (None, None, None, None, None), (5, "", "en", "x", 0), (6, "12 !!", "en", "x", 5), (7, (a + " ") * 200, "en", "y", 1)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit(c) for c in ("node", "key", "row", "part", "h", "spans", "score", "lang_pred", "target", "size")})
    folder = str(tmp_path / "odd")
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    step = odd
    for _, f in P.STAGES[:-1]:
        step = stage(f(spark, step, folder), "odd")
        assert step.columns == odd.columns
    got = P.run(spark, folder).toPandas()
    assert rows_of(got) == rows_of(P.token_output(spark, step, folder).toPandas()) and len(got) == step.count() > 100
    nothing = str(tmp_path / "none")
    odd.limit(0).write.parquet(f"{nothing}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0).write.parquet(f"{nothing}/benchmark.parquet")
    assert P.run(spark, nothing).count() == 0
