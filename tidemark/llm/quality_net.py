"""Quality by random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every word slot has a sparse random index vector; a word's vector is the sum of the index vectors of its neighbours over the
whole corpus, scaled to length one. A document is the mean of its words' vectors beside the mean size of the step from
one word to the next. A small network in numpy learns the labels from that; a temperature fitted on rows that it has
not seen makes its probabilities agree with frequencies.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import arrow_map, held_out, mix, slices, worker_cache
from tidemark.session import materialize

WORD = re.compile(r"\w+|[^\w\s]+")
SLOT_BITS = 15
DIM = 64
NONZERO = 2  # entries of an index vector that are 1 or -1
WINDOW = 2  # neighbours on either side
FIT_ROWS = 12_000  # labelled rows that the network is fitted on
RUN = 1 << 14  # words whose vectors are held at a time
PAIRS = 1 << 19  # pairs of neighbours that are counted at a time


class Slots(dict):
    """Slots of the words in every white-space delimited unit, as little-endian unsigned 16-bit bytes; a word's slot comes
    from the hash of its lower-case form. Emptied once it holds ``limit`` units."""

    limit = 500_000  # about 80 MB

    def __missing__(self, unit: str) -> bytes:
        found = [xxh3_64_intdigest(w.encode()) >> (64 - SLOT_BITS) for w in WORD.findall(unit.lower())]
        value = self[unit] = struct.pack(f"<{len(found)}H", *found)
        return value

    def of_text(self, text: str | None) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").split())), "<u2")


def index_vectors(seed: int) -> np.ndarray:
    """The non-zero entries of every slot's index vector, as place * 2 + (1 if the entry is -1)."""
    bits = mix(np.arange(NONZERO << SLOT_BITS, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))
    return ((bits >> np.uint64(8)) % np.uint64(2 * DIM)).astype(np.int64).reshape(-1, NONZERO)


class Contexts:
    """Sums of the index vectors of the neighbours of every slot's words, as whole numbers."""

    def __init__(self, seed: int):
        self.index, self.sums = index_vectors(seed), np.zeros((1 << SLOT_BITS, DIM), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, slots: np.ndarray) -> None:
        """``slots``: the words of one text."""
        for start in range(0, len(slots), PAIRS):
            part = slots[start : start + PAIRS + WINDOW]
            for step in range(1, WINDOW + 1):
                a, b = part[: PAIRS], part[step : PAIRS + step]
                self.pairs.append((a[: len(b)], b))
                self.waiting += len(b)
            if self.waiting >= PAIRS:
                self.count()

    def count(self) -> None:
        """Adds up the pairs that wait: one histogram over slot, place and sign."""
        if not self.pairs:
            return
        a, b = (np.concatenate(side).astype(np.int64) for side in zip(*self.pairs, strict=True))
        self.pairs, self.waiting = [], 0
        keys = [own * (2 * DIM) + self.index[near, k] for own, near in ((a, b), (b, a)) for k in range(NONZERO)]
        seen = np.bincount(np.concatenate(keys), minlength=self.sums.size * 2).reshape(-1, DIM, 2)
        self.sums += seen[:, :, 0]
        self.sums -= seen[:, :, 1]


def word_vectors(docs: DataFrame, text_col: str = "text", seed: int = 11) -> np.ndarray:
    """Vectors of all slots, float32, from all texts; zero for a slot without a neighbour.

    Sums are whole numbers, so any order of adding gives the same. A task sends one row per slot that it met; the table of
    all slots, ``2 ** SLOT_BITS`` rows whatever the corpus, is what comes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        numbers, contexts = worker_cache("quality slots", Slots), Contexts(seed)
        for (texts,) in slices(batches):
            for text in texts:
                contexts.add(numbers.of_text(text))
        contexts.count()
        at = np.flatnonzero(contexts.sums.any(axis=1))
        yield {"slot": at} | {f"c{i}": contexts.sums[at, i] for i in range(DIM)}

    names = [f"c{i}" for i in range(DIM)]
    parts = arrow_map(docs.select(text_col), run, "slot int, " + ", ".join(f"{c} long" for c in names))
    sums = parts.groupBy("slot").agg(*[F.sum(c).cast("double").alias(c) for c in names]).toPandas()
    out = np.zeros((1 << SLOT_BITS, DIM), np.float32)
    found = sums[names].to_numpy(np.float64).reshape(-1, DIM)
    length = np.sqrt((found * found).sum(axis=1, keepdims=True))
    out[sums["slot"].to_numpy(np.int64)] = found / np.where(length == 0, 1, length)
    return out


def pooled(vectors: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Mean vector of a text's words, then the root mean square of each entry's step from word to word; zero without words."""
    mean, step = np.zeros(DIM), np.zeros(DIM)
    for start in range(0, len(slots), RUN):
        part = vectors[slots[max(0, start - 1) : start + RUN]]
        mean += part[min(1, start) :].sum(axis=0)
        gap = part[1:] - part[:-1]
        step += np.einsum("ij,ij->j", gap, gap)
    return np.concatenate([mean / max(1, len(slots)), np.sqrt(step / max(1, len(slots) - 1))])


class Network:
    """Two layers, fitted by Adam on standardised inputs; ``temperature`` divides the margin."""

    def __init__(self, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, batch: int = 128) -> Network:
        draw = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        self.w = [draw.standard_normal((z.shape[1], self.hidden)) / np.sqrt(z.shape[1]), np.zeros(self.hidden),
                  draw.standard_normal(self.hidden) / np.sqrt(self.hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for epoch in range(self.epochs):
            order = draw.permutation(len(z))
            rate = self.rate * (1 - epoch / self.epochs)
            for start in range(0, len(z), batch):
                at = order[start : start + batch]
                step += 1
                for i, g in enumerate(self._gradients(z[at], y[at])):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    self.w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, b2 = self.w
        h = np.maximum(z @ w1 + b1, 0)
        g = (probability(h @ w2 + b2) - y) / len(y)
        back = np.outer(g, w2) * (h > 0)
        return [z.T @ back + self.decay * w1, back.sum(axis=0), h.T @ g + self.decay * w2, np.array([g.sum()])]

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        return np.maximum(((x - self.mean) / self.scale) @ w1 + b1, 0) @ w2 + b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """The temperature of the lowest log loss on rows that were not fitted, on a grid from 1/4 to 16."""
        margins, grid = self.margin(x), 2.0 ** np.linspace(-2, 4, 97)
        self.temperature = float(min(grid, key=lambda t: log_loss(margins / t, y)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return probability(self.margin(x) / self.temperature)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def log_loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -margin, margin))))


class Model:
    """Word vectors with the network; ``network`` is None where the labels cannot tell texts apart, and ``share`` the score."""

    def __init__(self, vectors: np.ndarray, network: Network | None, share: float):
        self.vectors, self.network, self.share = vectors, network, share

    def scores(self, texts: list, numbers: Slots) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        found = self.network.predict(np.array([pooled(self.vectors, numbers.of_text(t)) for t in texts]).reshape(-1, 2 * DIM))
        return np.round(found, 12)  # equal texts score the same wherever they stand in a batch


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """``id, text, label``: at most ``fit_rows`` rows of labelled documents outside the held-out fold, those whose hashed id is
    smallest; one row for every text of an id, and a label only where all of an id's labels agree."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.min(label_col).alias("label"), F.max(label_col).alias("high")).filter("label = high").drop("high")
    marks = marks.filter(~held_out("id"))
    here = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")).distinct()
    order = F.xxhash64(F.lit("quality"), "id", "text_key")
    chosen = materialize(here.join(marks, "id").orderBy(order, "id", "text_key").limit(fit_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.md5("text")).join(F.broadcast(chosen), ["id", "text_key"])  # at most fit_rows
    return rows.dropDuplicates(["id", "text_key"]).select("id", "text_key", "text", "label")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Word vectors from all texts, the network from at most ``fit_rows`` labelled ones.

    Labels come from documents outside the held-out fold; those other than 0 and 1, of unknown documents, or at odds with
    another label of the same id are left out; rows that repeat count once. Every fifth sampled row is kept from the network
    and sets the temperature. With one label only, all texts score the smoothed share of label 1, without any 0.5.
    """
    vectors = word_vectors(docs, text_col)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        numbers = worker_cache("quality slots", Slots)
        for ids, keys, texts, marks in slices(batches):
            found = [pooled(held.value, numbers.of_text(t)).tolist() for t in texts]
            yield {"id": ids, "text_key": keys, "x": found, "label": marks}

    sample = labelled(docs, labels, id_col, text_col, label_col, fit_rows).withColumn("id", F.col("id").cast("string"))
    rows = arrow_map(sample, run, "id string, text_key string, x array<double>, label int").toPandas()  # fit_rows at most
    rows = rows.sort_values(["text_key", "id"])  # an order without a trend, the same in every run
    x, y = np.array(rows["x"].tolist()).reshape(-1, 2 * DIM), rows["label"].to_numpy(np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    kept = np.arange(len(y)) % 5 > 0
    if not 0 < y[kept].sum() < kept.sum():
        return Model(vectors, None, float(share))
    network = Network().fit(x[kept], y[kept])
    if (~kept).any():
        network.calibrate(x[~kept], y[~kept])
    return Model(vectors, network, float(share))


def score(model: Model, text: Column | str) -> Column:
    """Probability of label 1 for a whole text; a null text scores as an empty one."""
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of_texts(texts: pa.Array) -> pa.Array:
        numbers, out = worker_cache("quality slots", Slots), []
        for i in range(0, len(texts), 256):
            out += held.value.scores(texts.slice(i, 256).to_pylist(), numbers).tolist()
        return pa.array(out, pa.float64())

    return of_texts(text)
