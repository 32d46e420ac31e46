"""Language identification, words first.

A word of the learned vocabulary is scored by its log frequency in each language. Any other word falls back to character
n-grams: at each position the longest known n-gram is used, from ``longest`` characters down to one. Scores of all words
of a text add up; the softmax of the sums is the confidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE, arrow_map, slices
from tidemark.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 4
FIT_ROWS = 10_000  # labelled rows that the model is fitted on
WORDS, GRAMS = 60_000, 60_000  # entries kept in the model


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams_of(word: str, n: int) -> Iterator[str]:
    """N-grams of a word with its borders; single characters come without borders."""
    padded = f"<{word}>" if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


def counts(rows: DataFrame) -> DataFrame:
    """``size, gram, lang, n``: how often words (size 0) and n-grams occur in the texts of each language.

    ``rows``: text, lang. Each task adds up its batches before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for texts, langs in slices(batches, 1024):
            seen: Counter = Counter()
            for text, lang in zip(texts, langs, strict=True):
                seen.update((word, lang) for word in words_of(text or ""))
            found: Counter = Counter()
            for (word, lang), n in seen.items():
                found[0, word, lang] = n
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        found[size, gram, lang] += n
            keys = list(found)
            yield {"size": [k[0] for k in keys], "gram": [k[1] for k in keys], "lang": [k[2] for k in keys], "n": list(found.values())}

    parts = arrow_map(rows.select("text", "lang"), run, "size int, gram string, lang string, n long")
    return parts.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language of a bounded number of words and n-grams."""

    def __init__(self, langs: list[str], entries: dict[int, dict[str, np.ndarray]], totals: dict[int, np.ndarray]):
        self.langs = langs
        self.tables = {}
        for size, grams in entries.items():
            base = np.log(totals[size] + 0.5 * (len(grams) + 1))
            self.tables[size] = {g: (np.log(n + 0.5) - base).astype(np.float32) for g, n in grams.items()}

    def word(self, word: str) -> np.ndarray:
        known = self.tables.get(0, {}).get(word)
        if known is not None:
            return known
        score, steps, at = np.zeros(len(self.langs), np.float32), 0, 0
        padded = f"<{word}>"
        while at < len(padded):
            for size in range(LONGEST, 0, -1):
                found = self.tables.get(size, {}).get(padded[at : at + size]) if at + size <= len(padded) else None
                if found is not None:
                    score, steps = score + found, steps + 1
                    break
            at += 1
        return score / max(1, steps)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Model from rows of ``id, text, lang``; null languages and texts are left out.

    It is fitted on the ``fit_rows`` rows whose hashed id is smallest (a documented bound, as for any fitted classifier);
    the most frequent ``words`` words and ``grams`` n-grams of each length come to the driver. No usable row gives a model
    that answers ``und``.
    """
    usable = rows.filter("lang is not null and text is not null")
    chosen = usable.select("id").orderBy(F.xxhash64(F.lit("langid"), "id"), "id").limit(fit_rows)
    sample = usable.join(F.broadcast(chosen.distinct()), "id", "left_semi")  # at most fit_rows ids
    table = counts(sample).groupBy("size", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("n"))
    table = materialize(table.filter("n > 1 or size < 3"))  # read once for every size
    kept = None
    for size in range(LONGEST + 1):
        top = table.filter(F.col("size") == size).orderBy(F.desc("n"), "gram").limit(words if size == 0 else grams)
        kept = top if kept is None else kept.unionByName(top)
    collected = kept.select("size", "gram", "by").collect()
    langs = sorted({lang for r in collected for lang in r["by"]})
    entries: dict[int, dict[str, np.ndarray]] = {}
    for r in collected:
        entries.setdefault(r["size"], {})[r["gram"]] = np.array([r["by"].get(lang, 0) for lang in langs], np.float64)
    return Model(langs, entries, {size: np.sum(list(g.values()), axis=0) for size, g in entries.items()})


class Scorer:
    """Scores texts with a model; keeps the scores of a bounded number of words."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.number: dict[str, int] = {}
        self.scores = np.zeros((limit * 2, len(model.langs)), np.float32)

    def add(self, word: str) -> int:
        at = self.number[word] = len(self.number)
        if at >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[at] = self.model.word(word)
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.model.langs or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.number) > self.limit:
            self.number.clear()
        for word in set(words):
            if word not in self.number:
                self.add(word)
        rows = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        total = self.scores[rows].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(model: Model, text: Column | str) -> Column:
    """Struct of ``lang`` and ``score`` of a whole text; ``und`` and 0 for a null text or one without a letter."""
    spark_model = _broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def score(texts: pa.Array) -> pa.Array:
        scorer = _scorer(spark_model)
        found = [scorer(t) for i in range(0, len(texts), SLICE) for t in texts.slice(i, SLICE).to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"]
        )

    return score(text)


def _broadcast(model: Model):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)


def _scorer(held, _kept: dict = {}) -> Scorer:  # noqa: B006
    """One scorer per worker process, for the model in use."""
    if _kept.get("of") is not held.value:
        _kept["of"], _kept["scorer"] = held.value, Scorer(held.value)
    return _kept["scorer"]
