"""Whitening of embeddings with an exact covariance by polarisation.

Entries become whole numbers, so sums over any number of tasks are exact in any order. For every dimension, and for every
sum of two dimensions, the squared centred values are added up. Since var(a + b) - var(a) - var(b) = 2 cov(a, b), the
differences give all covariances, and the eigenvectors of their matrix the whitening directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
ROWS = 1024  # vectors held as numbers at a time
SAFE = 1 << 62


def finite(vector: str) -> F.Column:
    """Vectors with at least one entry, all of them numbers."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``vec_id, x`` of the vectors that take part."""
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return named.filter(finite("v")).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with their vectors as rows of a matrix; ``x`` is the last column."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, np.asarray(part.column(part.num_columns - 1).flatten()).reshape(part.num_rows, dim)


def exact(values: np.ndarray, factor: int, terms: int) -> np.ndarray:
    """The same numbers, as Python's where ``terms`` products of ``factor`` times their largest square pass 64 bits."""
    most = factor * max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0))))
    return values.astype(object) if most * most * terms >= SAFE else values


class Moments:
    """Count, sums per dimension, and the sums of squares that polarisation needs, all as Python integers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # nearest whole number to the mean
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre, strict=True)]

    def covariance(self, squares: dict[tuple[int, int], int]) -> np.ndarray:
        """From sums of (x_i - c_i)^2 at (i, i) and of (x_i - c_i + x_j - c_j)^2 at (i, j), each divided out once."""
        n, out = self.n, np.zeros((self.dim, self.dim))
        centred = {  # n times the sum of squares about the mean
            (i, j): n * q - (self.rest[i] + (self.rest[j] if i != j else 0)) ** 2 for (i, j), q in squares.items()
        }
        for (i, j), q in centred.items():
            doubled = 2 * q if i == j else q - centred[i, i] - centred[j, j]
            out[i, j] = out[j, i] = doubled / (2 * n * n)
        return out


def moments(x: DataFrame) -> Moments | None:
    """None without a vector. Vectors of different lengths have no covariance and raise."""
    lengths = x.select(F.size("x").alias("dim")).groupBy("dim").count().limit(2).collect()
    if not lengths:
        return None
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths have no common covariance")
    dim, n = lengths[0]["dim"], lengths[0]["count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(dim, object)
        for _, m in matrices(batches, dim):
            total += exact(m, 1, 1).astype(object).sum(axis=0) if abs(m).max() > SAFE // ROWS else m.sum(axis=0).astype(object)
        yield {"i": list(range(dim)), "total": [str(t) for t in total]}

    sums = arrow_map(x.select("x"), run, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: int(r["total"]) for r in sums.collect()}  # one row per dimension
    return Moments(n, [found[i] for i in range(dim)])


def squares(x: DataFrame, known: Moments) -> dict[tuple[int, int], int]:
    """Sums of squared centred values of every dimension and of every sum of two; a task sends one row for each."""
    dim, centre = known.dim, known.centre

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = [np.zeros(dim - i, object) for i in range(dim)]
        for _, m in matrices(batches, dim):
            y = m - centre
            y = exact(y, 2, len(y))
            for i in range(dim):
                pair = y[:, i:] + y[:, i : i + 1]
                pair[:, 0] = y[:, i]
                total[i] += (pair * pair).sum(axis=0).astype(object)
        at = [(i, j) for i in range(dim) for j in range(i, dim)]
        yield {"i": [a for a, _ in at], "j": [b for _, b in at], "q": [str(total[i][j - i]) for i, j in at]}

    sums = arrow_map(x.select("x"), run, "i int, j int, q string").groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q"))
    return {(r["i"], r["j"]): int(r["q"]) for r in sums.collect()}  # dim * (dim + 1) / 2 rows


class Whitener:
    """Directions that bring the fit list to the identity covariance."""

    def __init__(self, known: Moments, covariance: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        floor = max(float(values.max(initial=0.0)), 0.0) * known.dim * np.finfo(float).eps * 16
        order = order[values[order] > floor]
        self.n, self.sums, self.centre = known.n, known.sums, known.centre
        self.rest = np.array([r / known.n for r in known.rest])  # what the mean lies beyond the whole centre
        self.turn = vectors[:, order] / np.sqrt(values[order])
        self.explained = values[order] / np.trace(covariance) if len(order) else np.zeros(0)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.rest) @ self.turn

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        y = x - self.centre
        y = exact(y, self.n, y.shape[1])
        rest = np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)], object)
        if y.dtype != object and max(map(abs, rest), default=0) <= self.n:
            most = self.n * (int(np.abs(y).max(initial=0)) + 1)
            if most * most * y.shape[1] < SAFE:
                gap = self.n * y - rest.astype(np.int64)
                return (gap * gap).sum(axis=1).tolist()
        gap = self.n * y.astype(object) - rest
        return (gap * gap).sum(axis=1).tolist()


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """From two scans; only the sums travel."""
    known = moments(x)
    return None if known is None else Whitener(known, known.covariance(squares(x, known)), components)


def identity_error(x: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured on all of them."""
    k, dim = len(model.explained), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        outer, sums = np.zeros((k, k)), np.zeros(k)
        for _, m in matrices(batches, dim):
            w = model.project(m)
            outer += w.T @ w
            sums += w.sum(axis=0)
        total = np.concatenate([outer.ravel(), sums])
        yield {"i": list(range(len(total))), "total": total}

    rows = arrow_map(x.select("x"), run, "i int, total double").groupBy("i").agg(F.sum("total").alias("total"))
    total = np.zeros(k * k + k)
    for r in rows.collect():  # one row per pair of components
        total[r["i"]] = r["total"]
    mean = total[k * k :] / model.n
    return float(np.abs(total[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    An entry c becomes floor(``scale`` c) + ``shift``. Vectors that are null or empty, or hold a null or non-finite entry,
    are left out; vectors of different lengths raise. Repeated rows count as often as they occur; a null id is carried;
    other columns are ignored. Components whose eigenvalue is zero in double precision have no whitened value and are left
    out, so equal vectors, a single one, or an empty table give no rows. ``deviation`` is exact: decimal(38, 0).
    """
    x = whole(vectors, id_col, vector_col, scale, shift)
    schema = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    model = fit(x, components)
    k = 0 if model is None else len(model.explained)
    if k == 0:
        out = vectors.sparkSession.createDataFrame([], schema)
        return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    error = identity_error(x, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, m in matrices(batches, len(model.sums)):
            rows = batch.num_rows
            deviation = pa.array([str(d) for d in model.deviation(m)])
            each = pa.array(np.repeat(np.arange(rows), k))
            yield {
                "vec_id": batch.column(0).take(each),
                "component": np.tile(np.arange(1, k + 1), rows),
                "n": np.full(rows * k, model.n),
                "deviation": deviation.take(each),
                "whitened": model.project(m).ravel(),
                "explained": np.tile(model.explained, rows),
                "identity_error": np.full(rows * k, error),
            }

    return arrow_map(x, run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
