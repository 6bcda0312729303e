"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

A source's documents are shuffled by a hash of the id. Copy e of a document finishes at virtual time
(e * source's tokens + tokens up to and with the document) / target. All copies are range-sorted by virtual time, and
the mix is truncated where the next one would pass the total budget; it is the longest such start of the order.

Running sums never need a source, or the whole order, in one task: a source is cut by the leading bits of the shuffle
hash and the order by ranges of time; each part is summed by itself and moved by the sums of the parts before it. Where
the truncation falls is then a sum within one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._util import before, ranged, stage, whole

PARTS = 4096
#: Words between white space, to be counted.
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, budget: int, most: int) -> DataFrame:
    """sources (source, source_size, weight) with target: budget by weight, none above most * source_size, what is
    above shared again by weight among the others until nothing is."""
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("source_size") * most * F.lit(level[1]) <= F.col("weight") * F.lit(level[0])
        r = sources.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size") * most)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weights")).first()
        step = (budget - int(r["full"]), int(r["weights"]))
        if step == level or step[1] <= 0:
            break
        level = step
    if level is None or step[1] <= 0:
        return sources.withColumn("target", (F.col("source_size") * most).cast("double"))
    share = (F.col("weight") * F.lit(level[0])).cast("double") / F.lit(level[1]).cast("double")
    return sources.withColumn("target", F.when(F.col("source_size") * most * F.lit(level[1]) <= F.col("weight") * F.lit(level[0]), (F.col("source_size") * most).cast("double")).otherwise(share))


def by_code_point(sources: DataFrame) -> DataFrame:
    """sources with weights 1, 2, 3, repeating, in order of their names, null last. Ranges of names are ranked each by
    itself, as there may be as many sources as web sites."""
    order = F.col("source").asc_nulls_last()
    rows = ranged(sources, order, label="mix-names")
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    rows = rows.join(before(rows, F.count("*")), "part")
    return rows.select(*sources.columns, ((F.col("own") + F.col("before") - 1) % 3 + 1).cast("long").alias("weight"))


def queue(docs: DataFrame, *, weights: Column | None = None, budget: int | None = None, most: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, documents): every copy with its virtual finish time, and each document with its source's figures.
    weights: an expression of source and source_size; by default the order of the sources' names gives them."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), _size(text).alias("size"), shuffle(F.col(f"`{id_col}`"), text, seed).alias("h")), "mix-rows")
    part = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")  # PARTS of them
    rows = rows.withColumn("part", part)
    parts = stage(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix-parts")  # of sums, at most PARTS a source
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    sources = by_code_point(sources) if weights is None else sources.withColumn("weight", weights.cast("long"))
    sources = stage(sources, "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    aims = targets(sources, total if budget is None else budget, most)
    upto = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = parts.withColumn("before", upto).join(aims.withColumnRenamed("source", "a_source"), F.col("source").eqNullSafe(F.col("a_source")))
    known = known.select(F.col("source").alias("k_source"), F.col("part").alias("k_part"), "before", "source_size", "target")
    own = F.sum("size").over(Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn("own", own).join(known, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("part") == F.col("k_part")))
    documents = stage(held.select("doc_id", "source", "size", "h", "source_size", "target", (F.col("own") + F.col("before")).alias("upto")), "mix-documents")
    times = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (e * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
    copies = documents.where("size > 0 AND target > 0").select("doc_id", "source", "size", "h", F.posexplode(times).alias("epoch", "finish"))
    return copies, documents


def _size(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")


def shuffle(key: Column, text: Column, seed: str) -> Column:
    """What a source's documents are ordered by: a hash of id and seed; of the text, where there is no id."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.concat(F.lit("no id "), F.md5(F.coalesce(text, F.lit(""))))), F.lit(f":{seed}")))


def truncated(copies: DataFrame, budget: int) -> float | None:
    """The last virtual time at which all copies so far stay within the budget; None if even the first don't.

    The copies' times are range-sorted and staged; a range's sum is known from its own rows, so only the range in which
    the budget ends is summed row by row. Copies of one time are taken or left together.
    """
    order = ranged(copies.select("finish", "size"), "finish", label="mix-order")
    sums = order.groupBy("part").agg(F.sum("size").alias("part_sum"), F.max("finish").alias("last"))
    total = F.sum("part_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # of ranges
    sums = stage(sums.withColumn("total", total), "mix-ranges")
    inside = sums.where(F.col("total") <= budget).agg(F.max("part").alias("part"), F.max("last").alias("last"), F.max("total").alias("total")).first()
    over = sums.where(F.col("total") > budget).agg(F.min("part")).first()[0]
    if over is None:
        return inside.last
    own = order.where(F.col("part") == over).groupBy("finish").agg(F.sum("size").alias("w"))
    own = own.withColumn("total", F.sum("w").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(inside.total or 0))
    here = own.where(F.col("total") <= budget).agg(F.max("finish")).first()[0]
    return inside.last if here is None else here


def mix(docs: DataFrame, *, budget: int | None = None, **options) -> DataFrame:
    """The mix itself: doc_id, source, size, epoch, finish of each copy taken, in global order of virtual time."""
    copies, documents = queue(docs, budget=budget, **options)
    budget = budget if budget is not None else documents.agg(F.sum("size")).first()[0] or 0
    end = truncated(copies, budget)
    return copies.where(F.lit(False) if end is None else F.col("finish") <= F.lit(end)).orderBy("finish", "h", "doc_id").drop("h")


def apply(docs: DataFrame, *, budget: int | None = None, most: int = 3, weights: Column | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most_broadcast: int = 10_000) -> DataFrame:
    """docs as the mix has them: rows it doesn't take are gone, rows it repeats are there up to `most` times.

    What an epoch takes of a source is a start of the source's order, so the last place taken of each says it all; texts
    aren't moved. Those places are broadcast while the sources are at most most_broadcast, else joined by a shuffle.
    Rows equal in id and size are taken together. Documents without words are left out.
    """
    copies, documents = queue(docs, weights=weights, budget=budget, most=most, seed=seed, id_col=id_col, source_col=source_col, text_col=text_col)
    budget = budget if budget is not None else documents.agg(F.sum("size")).first()[0] or 0
    end = truncated(copies, budget)
    last = copies.where(F.lit(False) if end is None else F.col("finish") <= F.lit(end)).groupBy("source", "epoch").agg(F.max(F.struct("h", "doc_id", "size")).alias("last"))
    last = stage(last.groupBy(F.col("source").alias("m_source")).agg(*[F.max(F.when(F.col("epoch") == e, F.col("last"))).alias(f"m_last{e}") for e in range(most)]), "mix-last")
    text, key = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    place = F.struct(shuffle(key, text, seed).alias("h"), key.alias("doc_id"), _size(text).alias("size"))
    rows = docs.where(text.isNotNull()).select(whole(docs, "m_row"), F.col(f"`{source_col}`").cast("string").alias("m_own"), place.alias("m_place")).where("m_place.size > 0")
    side = F.broadcast(last) if last.count() <= most_broadcast else last
    rows = rows.join(side, F.expr("m_own <=> m_source"))
    times = sum((F.coalesce((F.col("m_place") <= F.col(f"m_last{e}")).cast("int"), F.lit(0)) for e in range(most)), F.lit(0))
    return rows.withColumn("m_times", times).where("m_times > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_times")))).select("m_row.*")


def taken(docs: DataFrame, *, budget: int | None = None, most: int = 3, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (tokens that the mix takes, repeats counted).

    Null texts and those without words have size 0 and are never taken; null sources are one source, the last; rows
    without an id are shuffled by their text; ids may be of any type that can be ordered; equal rows stand beside each other in a source's order. Target is 0 for a source without words.
    An empty table gives none. Reruns agree, as the shuffle is a hash of id and seed.
    """
    copies, documents = queue(docs, budget=budget, most=most, **options)
    budget = budget if budget is not None else documents.agg(F.sum("size")).first()[0] or 0
    end = truncated(copies, budget)
    times = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (e * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
    repeats = F.lit(0) if end is None else F.when((F.col("size") > 0) & (F.col("target") > 0), F.size(F.filter(times, lambda t: t <= F.lit(end)))).otherwise(0)
    return documents.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).cast("long").alias("taken"))
