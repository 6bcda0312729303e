"""Corpus preparation as a chain of stages, each over all that its predecessor kept.

Language ID drops documents without a letter or without a clear language; the n-gram join leaves one document of each
group of near copies, by 5 words and 0.8 (the query op3 has thresholds of its own); decontamination drops documents that
are largely benchmark text and cuts benchmark passages from the others; mixing repeats or leaves out documents until
sources have their target weights; the last stage writes token ids as sorted string tables and returns what is read back.

Every stage takes the columns of documents, and any others, and texts of any length, read whole. An empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, langid, mixing, ngram_join, sstable
from tickloom.llm._util import discard, settled
from tickloom.llm.queries import tokenizer_spec

#: Documents whose best language has a lower posterior are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is clear, with their columns as they were. Null texts, texts without a letter and those whose
    best language has a posterior below LEAST_SCORE go. Languages are learnt from docs' own labels (rows without one are
    judged like others); equal texts are judged alike, so repeated rows stay or go together; ties go to the first
    language in order."""
    names = ("_pipeline_lang", "_pipeline_score")
    scored = langid.predict(docs, langid.fit(docs), names=names)
    return scored.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by 5-word shingles at 0.8: that of the smallest id, of rows that tie in
    id one. Null ids come last; texts without words, of which a stage before may have left none, all stay."""
    return ngram_join.deduplicate(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those of whose words a twentieth or more stand in benchmark passages; from the others such passages
    are cut, and n_chars follows. Null texts stay; repeated rows are treated alike; without a benchmark all stay as they are."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them, up to three times; documents without words are left out. Null sources are one
    source, the last in order; rows equal in id and size are taken together."""
    return mixing.apply(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the shards, in order of doc_id, null ids first, rows
    of one id by text. A null text has the end id alone."""
    return sstable.digest(spark, sstable.write(docs, tokenizer_spec(), remember=32 << 20, batch_bytes=1 << 20, across_tasks=False))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]
#: Language ID and token ids can't be stated in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage over the staged output of the one before it. A stage's input and all that it
    has staged on the way are removed once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        last, docs = docs, settled(lambda step=step, docs=docs: step(spark, docs, sf_dir), name.split()[0].lower())
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
