"""Language identification by a word-first backoff.

A known word adds its log frequency in each language. An unseen word is cut at each of its characters into the longest
known character n-gram that ends there, from NGRAM down to one; those log frequencies are added instead (a step down
costs the same in every language, so it doesn't count). The sum over a text's words, divided by the root of their
number, gives posteriors by softmax.

The model is fitted on a bounded sample of labelled rows: about `per_language` different texts a language, and `in_all`
of all languages, chosen by a hash of the text. Everything in the sample counts: words from two occurrences on are known,
others are read by their n-grams. Frequencies are kept sparse, an entry for each language that a word or n-gram was seen
in, so languages cost what they were seen with, however many they are.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import _scan
from tickloom.llm._util import ddl, release, stage
from tickloom.shipping import ship

PER_LANGUAGE, IN_ALL = 4000, 200_000
NGRAM, ALPHA, KNOWN_FROM = 4, 0.5, 2
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+").findall


def _words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case: the same in training and prediction."""
    return _LETTERS(text.lower()) if text else []


def _counted(batches):
    """kind (0 word, 1 n-gram), g, lang, c of the texts of a batch (lang, text)."""
    for batch in batches:
        for part in _scan.slices(batch, "text", 1 << 19):
            by: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, Counter()).update(_words(text))
            for lang, words in by.items():
                grams: Counter = Counter()
                for w, c in words.items():
                    w = f"^{w}$"
                    for n in range(1, NGRAM + 1):
                        for i in range(len(w) - n + 1):
                            grams[w[i : i + n]] += c
                for kind, found in ((0, words), (1, grams)):
                    rows = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * rows, pa.int32()), pa.array(list(found), pa.string()), pa.array([lang] * rows, pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "g", "lang", "c"])
    release()


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> dict:
    """A model from rows whose text and language are not null; without any, it has no languages.

    Copies of a text count once. Of which texts are taken a hash of the text decides, so repeated rows, their order and
    ties don't matter; texts of any length are read whole.
    """
    ship(train.sparkSession)
    rows = train.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).dropna()
    digest = F.md5("text")
    sizes = stage(rows.select("lang", digest.alias("k")).distinct().groupBy("lang").agg(F.count("*").alias("texts")), "languages")
    langs = sorted(r.lang for r in sizes.select("lang").collect())
    if not langs:
        return {"langs": []}
    share = F.lit(float(max(1, min(per_language, in_all // len(langs))))) / F.col("texts")
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sizes = sizes.withColumnRenamed("lang", "s_lang")
    sample = rows.join(sizes, F.col("lang") == F.col("s_lang")).where(at < share).groupBy("lang", digest.alias("k")).agg(F.first("text").alias("text"))
    counts = sample.select("lang", "text").mapInArrow(_counted, "kind int, g string, lang string, c long")
    counts = stage(counts.groupBy("kind", "g", "lang").agg(F.sum("c").alias("c")), "frequencies")
    return {"langs": langs, "words": _table(counts.where("kind = 0"), langs, KNOWN_FROM), "grams": _table(counts.where("kind = 1"), langs, 1)}


def _table(counts: DataFrame, langs: list[str], least: int) -> dict:
    """keys; for each, from first[i] to first[i + 1], languages and by how much they are above `base`, the log frequency
    of what a language wasn't seen with."""
    got = counts.groupBy("g").agg(F.sum("c").alias("total"), F.sort_array(F.collect_list(F.struct("lang", "c"))).alias("of")).where(F.col("total") >= least)
    got = got.select("g", F.col("of.lang").alias("lang"), F.col("of.c").alias("c")).toArrow().combine_chunks()
    if not len(got):
        return {"keys": [], "first": np.zeros(1, np.int64), "lang": np.zeros(0, np.int32), "above": np.zeros(0, np.float32), "base": np.zeros(len(langs))}
    lists = got["lang"].combine_chunks()
    lang = pc.index_in(lists.flatten(), pa.array(langs)).to_numpy().astype(np.int32)
    c = got["c"].combine_chunks().flatten().to_numpy().astype(np.float64)
    sums = np.bincount(lang, weights=c, minlength=len(langs))
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    return {"keys": got["g"].to_pylist(), "first": first, "lang": lang, "above": np.log((c + ALPHA) / ALPHA).astype(np.float32), "base": np.log(ALPHA / (sums + ALPHA * (len(got) + 1)))}


class Scorer:
    """Posteriors of texts under a model. Nothing is remembered from one call to the next."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        if self.langs:
            self.words, self.grams = model["words"], model["grams"]
            self.word_keys, self.gram_keys = (pa.array(t["keys"], pa.string()) for t in (self.words, self.grams))

    @staticmethod
    def _spread(table: dict, rows: np.ndarray, own: np.ndarray, owners: int, langs: int) -> np.ndarray:
        """owners x langs: the sums of table's rows, each added to its owner."""
        a, b = table["first"][rows], table["first"][rows + 1]
        lengths = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        place = np.repeat(own, lengths) * langs + table["lang"][at]
        sums = np.bincount(place, weights=table["above"][at], minlength=owners * langs).astype(np.float64)  # of none, integers
        return sums.reshape(owners, langs)

    def _unseen(self, words: list[str]) -> np.ndarray:
        """words x languages: what their n-grams add."""
        pieces, own = [], []
        for k, w in enumerate(words):
            w = f"^{w}$"
            for end in range(2, len(w) + 1):
                for n in range(NGRAM, 0, -1):
                    pieces.append(w[end - n : end] if n <= end else "")
            own += [k] * (len(w) - 1)
        found = pc.index_in(pa.array(pieces, pa.string()), self.gram_keys).fill_null(-1).to_numpy().reshape(-1, NGRAM)
        known = found >= 0
        row = found[np.arange(len(found)), known.argmax(axis=1)]
        own = np.array(own, dtype=np.int64)
        hit = row >= 0  # else no n-gram is known, not even the last character: as rare as can be in each language
        out = self._spread(self.grams, row[hit], own[hit], len(words), len(self.langs))
        return out + np.bincount(own, minlength=len(words))[:, None] * self.grams["base"]

    def score(self, raw: list[str | None]) -> tuple[list[str], list[float]]:
        words = [_words(t) for t in raw]
        sizes = np.array([len(own) for own in words], dtype=np.int64)
        judged = [bool(self.langs) and any(w.isalpha() or any(map(str.isalpha, w)) for w in own) for own in words]
        if not any(judged):
            return [UNKNOWN] * len(raw), [0.0] * len(raw)
        said = pa.array([w for own in words for w in own], pa.string()).dictionary_encode()
        different, at = said.dictionary, said.indices.to_numpy()
        row = pc.index_in(different, self.word_keys).fill_null(-1).to_numpy()
        doc, at_row = np.repeat(np.arange(len(raw)), sizes), row[at]
        known = at_row >= 0
        total = self._spread(self.words, at_row[known], doc[known], len(raw), len(self.langs))
        total += np.bincount(doc[known], minlength=len(raw))[:, None] * self.words["base"]
        new = np.flatnonzero(row < 0)
        if len(new):
            extra = self._unseen(different.take(pa.array(new)).to_pylist())
            place = np.full(len(row), -1)
            place[new] = np.arange(len(new))
            of, by = place[at[~known]], doc[~known]
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(by, weights=extra[of, k], minlength=len(raw))
        best, top = [], []
        for i, ok in enumerate(judged):
            if not ok:
                best.append(UNKNOWN)
                top.append(0.0)
                continue
            own = total[i] / math.sqrt(sizes[i])
            p = np.exp(own - own.max())
            k = int(p.argmax())
            best.append(self.langs[k])
            top.append(float(p[k] / p.sum()))
        return best, top


def predict(docs: DataFrame, model: dict, *, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (0 to 1), or `names`, which replace columns of those names.

    lang_pred is `und` with score 0 where the text is null or has no letter, or the model has no language. Ties go to
    the first language in order. Texts are scored whole; equal texts score alike.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*names)
    held = spark.sparkContext.broadcast(pickle.dumps(model))  # bytes: a worker keeps what is broadcast after its task

    def run(batches):
        scorer = None
        for batch in batches:
            for part in _scan.slices(batch, text_col, 1 << 19):
                scorer = scorer or Scorer(pickle.loads(held.value))
                best, top = scorer.score(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(top, pa.float64())], [*part.schema.names, *names])
        scorer = None
        release()

    return docs.mapInArrow(run, f"{ddl(docs)}, `{names[0]}` string, `{names[1]}` double")
