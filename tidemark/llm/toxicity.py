"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Every coordinate has its own learning rate, from the sum of its squared gradients; the L1 term keeps a coordinate at zero
until the evidence for it is strong, so the weights that travel to the tasks are few.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE, WordIds, arrow_map, held_out, mix, slices, worker_cache
from tidemark.session import materialize

WORD = re.compile(r"[^\W_]+")
BITS = 20
FIT_ROWS = 12_000  # labelled rows that the model is fitted on


class TextIds(WordIds):
    def __missing__(self, word: str) -> int:
        value = self[word] = self.hash(word.encode(), self.seed)
        return value


def features(text: str, numbers: TextIds, bits: int = BITS) -> np.ndarray:
    """Hashed numbers of a text's words, word pairs and pairs that skip one word, with repeats. 0 is kept for the bias."""
    words = numbers.of(WORD.findall(text.lower()))
    pairs = mix(words[:-1]) + words[1:] * np.uint64(3)
    skips = mix(words[:-2] ^ np.uint64(0x5BD1E995)) + words[2:] * np.uint64(5)
    return ((mix(np.concatenate([words, pairs, skips])) >> np.uint64(64 - bits)) | np.uint64(1)).astype(np.int64)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(35.0, max(-35.0, x))))


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin that parts the labels with the highest F1, in the middle between its neighbours; 0 without both labels."""
    if not 0 < labels.sum() < len(labels):
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + hits[-1])
    f1[:-1][m[:-1] == m[1:]] = -1  # equal margins are not parted
    at = int(f1.argmax())
    return float((m[at] + m[at + 1]) / 2) if at + 1 < len(m) else float(m[at] - 1)


class FTRL:
    """Per-coordinate follow-the-regularised-leader for log loss over sets of active features."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float, positive: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2, self.positive = alpha, beta, l1, l2, positive
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        return self._weights(self.z[at], np.sqrt(self.n[at]))

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        beyond = z - np.clip(z, -self.l1, self.l1)  # 0 inside the L1 band
        return -beyond / ((self.beta + root) / self.alpha + self.l2)

    def learn(self, active: np.ndarray, label: int) -> None:
        z, n = self.z[active], self.n[active]
        root = np.sqrt(n)
        w = self._weights(z, root)
        g = sigmoid(w.sum()) - label
        if label:
            g *= self.positive
        n += g * g
        self.z[active] = z + (g - (np.sqrt(n) - root) * w / self.alpha)
        self.n[active] = n


class Weights:
    """The non-zero weights, as a dense array for look-up."""

    def __init__(self, at: np.ndarray, value: np.ndarray, bits: int):
        self.at, self.value, self.bits = at, value, bits

    def tells(self) -> bool:
        """Whether any feature has a weight; the bias alone gives all texts one score."""
        return bool((self.at != 0).any())

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.value
        return out


def fit(
    rows: DataFrame,
    fit_rows: int = FIT_ROWS,
    epochs: int = 4,
    bits: int = BITS,
    alpha: float = 4.0,
    beta: float = 1.0,
    l1: float = 12.0,
    l2: float = 0.0,
    positive: float = 2.0,
    least: int = 3,
) -> Weights:
    """Weights from rows of ``id, text, label`` (0 or 1; others are left out).

    FTRL is sequential, so it is fitted on a bounded sample: the ``fit_rows`` different (id, text) whose hashed id is
    smallest, in that order, ``epochs`` times, in one task; rows that repeat count once, with the highest label. Features of fewer than ``least`` rows are left out. Label 1 weighs ``positive``
    times as much as label 0. A first training without every fifth row finds the cut of the best F1 on these; it is taken
    off the bias of the second, over all rows, so that 0.5 is that cut. Without a usable row all weights are zero and
    every score is 0.5; with rows but no label 1 the bias keeps every score below 0.5.
    """
    usable = rows.filter("label in (0, 1)").select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"))
    usable = usable.withColumn("text_key", F.md5("text"))
    order = F.xxhash64(F.lit("toxicity"), "id")
    different = usable.groupBy("id", "text_key").agg(F.max("label").alias("label"))
    chosen = materialize(different.orderBy(order, "id", "text_key").limit(fit_rows))
    sample = usable.drop("label").join(F.broadcast(chosen), ["id", "text_key"])  # at most fit_rows
    sample = sample.dropDuplicates(["id", "text_key"]).select("id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        numbers, seen = TextIds(), []
        for _, texts, labels in slices(batches):
            for text, label in zip(texts, labels, strict=True):
                active = np.unique(np.append(features(text, numbers, bits), 0)).astype(np.int32)
                seen.append((active, label))
        rows_with = np.zeros(1 << bits, np.int32)
        for active, _ in seen:
            rows_with[active] += 1
        seen = [(a[(rows_with[a] >= least) | (a == 0)], y) for a, y in seen]

        def trained(part: list) -> np.ndarray:
            model = FTRL(bits, alpha, beta, l1, l2, positive)
            for _ in range(epochs):
                for active, label in part:
                    model.learn(active, label)
            return model.weights(slice(None))

        w = trained([x for i, x in enumerate(seen) if i % 5])
        cut = best_cut(np.array([w[a].sum() for a, _ in seen[::5]]), np.array([y for _, y in seen[::5]]))
        w = trained(seen)
        w[0] -= cut
        if seen and not any(y for _, y in seen):
            w[0] = min(w[0], -1.0)  # no other weight is above 0
        at = np.flatnonzero(w)
        yield {"at": at, "value": w[at]}

    ordered = sample.repartition(1).sortWithinPartitions(order, "id", "text", "label")
    found = arrow_map(ordered, run, "at int, value double").toPandas()
    return Weights(found["at"].to_numpy(np.int64), found["value"].to_numpy(np.float64), bits)


def score(weights: Weights, text: Column | str, unknown: float | None = None) -> Column:
    """Probability of label 1 for a whole text; a null text scores as an empty one. Where the labels were too few to give
    any feature a weight, every text scores ``unknown``, if that is given."""
    if unknown is not None and not weights.tells():
        return F.lit(float(unknown))
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        dense, numbers = _dense(held), worker_cache("toxicity words", TextIds)
        out = []
        for i in range(0, len(texts), SLICE):
            for text in texts.slice(i, SLICE).to_pylist():
                at = features(text or "", numbers, held.value.bits)
                at = np.unique(at[dense[at] != 0.0])
                out.append(sigmoid(dense[at].sum(dtype=np.float64) + dense[0]))
        return pa.array(out, pa.float64())

    return probability(text)


def _dense(held, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if _kept.get("of") is not held.value:
        _kept["of"], _kept["dense"] = held.value, held.value.dense()
    return _kept["dense"]


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> Weights:
    """Weights from the ``toxic`` labels of documents outside the held-out fold; a document with several labels counts
    as toxic if one of them says so. Labels of other documents do not count towards ``fit_rows``. Of an id with several texts
    each counts; an empty table gives weights that tell nothing."""
    marks = labels.filter(f"{id_col} is not null").groupBy(id_col).agg(F.max("toxic").alias("label"))
    marks = marks.filter(~held_out(id_col)).withColumnRenamed(id_col, "id")
    order = F.xxhash64(F.lit("toxicity"), "id")
    here = docs.select(F.col(id_col).alias("id")).distinct()
    marks = marks.filter("label in (0, 1)").join(here, "id", "left_semi")
    marks = marks.orderBy(order, "id").limit(options.get("fit_rows", FIT_ROWS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id")
    return fit(rows, **options)
