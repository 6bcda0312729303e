"""Toxicity scores by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

A text's features are the hashes of its words (digits, a-z, all outside ASCII; A-Z lower-cased), of pairs of neighbours
and of pairs with one word between, each present or not. Training keeps a learning rate for each coordinate, and L1
leaves most weights exactly zero; what is broadcast is the list of the others, at most 2**BITS of them.

Labels are learnt from a bounded sample: at most `per_class` documents of each label, by a hash of the id. Texts are
read whole, in slices of about 1 MB; one text of any length is a row of at most three features a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _scan
from tickloom.llm._util import ddl
from tickloom.shipping import ship

BITS, PER_CLASS, EPOCHS = 22, 4000, 10
RATE, BETA, L1, L2 = 2.0, 1.0, 15.0, 0.1


def _features(part: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, feature) of every occurrence; unsorted, with repeats."""
    words = _scan.Words(*_scan.texts(part), _scan.ALNUM)
    own, h = words.docs(), words.hashes
    shift = np.uint64(64 - BITS)
    docs, found = [own], [h]
    for gap in (1, 2):
        if len(h) > gap:
            same = np.flatnonzero(own[:-gap] == own[gap:])
            docs.append(own[same])
            found.append(_scan.mix(h[same] * np.uint64(0x9FB21C651E98DF25) + h[same + gap] + np.uint64(gap)))
    return np.concatenate(docs), (np.concatenate(found) >> shift).astype(np.int64), len(words.offsets) - 1


def ftrl(rows: list[tuple[np.ndarray, int]], *, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the coordinates that L1 leaves, from (features, label) rows taken in order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, which has no L1

    def weights(at, l1):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(nn)) / RATE + L2))

    for _ in range(epochs):
        for features, label in rows:
            at = np.append(features, size)
            l1 = np.full(len(at), L1)
            l1[-1] = 0.0
            w = weights(at, l1)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE
            z[at] += g - sigma * w
            n[at] += g * g
    places = np.flatnonzero(np.abs(z[:size]) > L1)
    return places, weights(places, L1).astype(np.float32), float(weights(np.array([size]), 0.0)[0])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from labelled documents. Null labels and ids are left out; of several labels of a document the largest
    counts, and of several texts the last in order, so repeated rows don't enlarge the sample. Empty tables give no weights."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    chosen = known.where("y = 1").orderBy("h", "id").limit(per_class).union(known.where("y = 0").orderBy("h", "id").limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("h", "id", "y").agg(F.max("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                own, at, count = _features(part.column("text"))
                key = np.unique(own * (1 << BITS) + at)
                cuts = np.searchsorted(key >> BITS, np.arange(1, count))
                lists = np.split((key & ((1 << BITS) - 1)).astype(np.int32), cuts)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("id"), part.column("y"), pa.array(lists, pa.list_(pa.int32()))], ["h", "id", "y", "at"])

    kind = texts.schema["id"].dataType.simpleString()
    got = texts.mapInArrow(run, f"h long, id {kind}, y int, at array<int>").toArrow()
    got = got.combine_chunks().sort_by([("h", "ascending"), ("id", "ascending")])
    return ftrl([(at.values.to_numpy(), y.as_py()) for at, y in zip(got["at"], got["y"])], epochs=epochs)


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text") -> DataFrame:
    """docs with score, from 0 to 1, which replaces a column of that name. Null and empty texts get the bias alone."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score")
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        dense = None
        for batch in batches:
            for part in _scan.slices(batch, text_col):
                if dense is None:
                    places, weights, bias = held.value
                    dense = np.zeros(1 << BITS, dtype=np.float32)
                    dense[places] = weights
                own, at, count = _features(part.column(text_col))
                near = np.flatnonzero(dense[at])
                key = np.unique(own[near] * (1 << BITS) + at[near])
                total = bias + np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=count)
                score = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])

    return docs.mapInArrow(run, f"{ddl(docs)}, score double")
