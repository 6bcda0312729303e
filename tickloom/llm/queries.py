"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import chat_format, decontaminate, langid, media, mixing, ngram_join, sharding, sstable, toxicity, url_rules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_read(spark, sf_dir, "documents"), shards=24)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_read(spark, sf_dir, "documents"))


def tokenizer_spec(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The JSON of a public tokenizer; folder: where its file is, else the installed package's."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = f"{folder}/{name}"
    with open(path, encoding="utf-8") as f:
        return f.read()


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digest(spark, sstable.write(_read(spark, sf_dir, "documents"), tokenizer_spec()))


#: (host, path, verdict) that op5 judges by.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_read(spark, sf_dir, "pages"), rules)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(_read(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents"))


def held_out() -> Column:
    """A third of the documents, by their id, is kept from training. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: (name, parameter, type, required) of the tools that op9's calls are checked against.
TOOLS = [("lookup", "query", "string", True), ("lookup", "words", "integer", False), ("count", "words", "integer", True)]


def with_tools(turns: DataFrame) -> DataFrame:
    """conversations with tool use, by a rule on conv_id and turn alone, as the given ones have none: every turn of the
    assistant makes a call, in one of the two usual shapes, some with arguments that don't fit; four in five get a
    result, logged after the call's turn or before it; some results answer no call."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    t = t.withColumns({"k": F.expr("(conv_id * 3 + turn) % 7"), "id": F.concat(F.lit("c"), F.col("turn").cast("string"))})
    call = """CASE WHEN (conv_id + turn) % 2 = 0
        THEN to_json(named_struct('id', id, 'name', 'lookup', 'arguments', named_struct('query', CASE WHEN k <> 0 THEN substr(md5(coalesce(text, '')), 1, 8) END, 'words', k)))
        ELSE to_json(named_struct('id', id, 'type', 'function', 'function', named_struct('name', 'count', 'arguments', CASE WHEN k % 3 = 0 THEN '{"words":"many"}' ELSE concat('{"words":', k, '}') END))) END"""
    said = f"concat(substring(to_json(named_struct('content', coalesce(text, ''))), 1, length(to_json(named_struct('content', coalesce(text, '')))) - 1), ',\"tool_calls\":[', {call}, ']}}')"
    talk = t.select("conv_id", "turn", "role", F.expr(f"CASE WHEN role = 'assistant' THEN {said} ELSE text END").alias("text"))
    given = t.where("role = 'assistant' AND (conv_id + 2 * turn) % 5 <> 0").select("conv_id", F.expr("CASE WHEN k % 2 = 0 THEN turn + 1 ELSE turn - 1 END").alias("turn"), F.lit("tool").alias("role"), F.to_json(F.struct(F.struct(F.col("turn").alias("n")).alias("content"), F.col("id").alias("tool_call_id"))).alias("text"))
    odd = t.where("role = 'user' AND turn % 6 = 4").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(F.lit("?").alias("content"), F.concat(F.lit("x"), F.col("turn").cast("string")).alias("tool_call_id"))).alias("text"))
    return talk.unionByName(given).unionByName(odd)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TOOLS, "name string, parameter string, type string, required boolean")
    return chat_format.format_chat(with_tools(_read(spark, sf_dir, "conversations")), tools)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}
