"""Exact nearest neighbours over grouped vectors.

Vectors are grouped by the centre they lie nearest to, and a group knows the largest angle between its centre and a member.
By the triangle inequality on the sphere no member of a group can be nearer to a query than the query's angle to the centre
less that radius. A search first reads, for each query, the groups it lies nearest to, which hold ``k`` vectors at least;
their ``k``-th best score is what any other vector has to beat, and only groups that can are read after that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.knn import SCORE_DIGITS, QueryVectors, _make_scorer, best_hits, blocks_of, query_vectors
from tidemark.session import materialize

GROUPS = 1024  # centres; a task compares each vector with all of them once
SLACK = 2e-7  # radians; covers rounded scores and the arithmetic of angles


@dataclass(frozen=True)
class Grouped:
    """Stored ``_id, _vec, _group``, sorted by group, with the centres, radii (radians) and sizes of the groups."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit rows, from chords for near ones, where the arc cosine is coarse."""
    dot = np.clip(a @ b.T, -1.0, 1.0)
    return np.where(dot > 0.99, 2 * np.arcsin(np.sqrt(np.maximum(0.0, 2 - 2 * dot)) / 2), np.arccos(dot))


def build(chunks: DataFrame, groups: int = GROUPS, id_col: str = "chunk_id", vector_col: str = "embedding") -> Grouped | None:
    """Group all vectors around ``groups`` of them, those whose hashed id is smallest; None without a usable vector.

    Vectors that are null, of length zero or of another size than the first centre match nothing and are left out, as
    plain search does. Large groups are spread over tasks, which sort by group and id.
    """
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.exists(vector_col, lambda x: x != 0)
    pool = chunks.where(usable).select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vec"))
    chosen = pool.orderBy(F.xxhash64("_id"), "_id").limit(groups).toArrow().column("_vec").to_pylist()
    if not chosen:
        return None
    dim = len(chosen[0])
    centres = unit(np.array([c for c in chosen if len(c) == dim], dtype=float))
    pool = pool.where(F.size("_vec") == dim)
    out = T.StructType([*pool.schema.fields, T.StructField("_group", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, dim)
                apart = angles(unit(block), centres)
                group = apart.argmin(axis=1).astype(np.int32)
                columns = [*batch.columns, pa.array(group), pa.array(apart[np.arange(len(group)), group])]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    placed = materialize(pool.mapInArrow(assign, out).repartitionByRange("_group", "_id").sortWithinPartitions("_group", "_id"))
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("_group").agg(F.max("_angle").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # one row per group
        radius[r["_group"]], size[r["_group"]] = r["far"], r["n"]
    return Grouped(placed.drop("_angle"), centres, radius, size)


def home_groups(apart: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Which groups each query reads first: the nearest ones that hold ``k`` vectors together (``query x group``)."""
    order = np.argsort(apart, axis=1, kind="stable")
    before = np.cumsum(size[order], axis=1) - size[order]
    home = np.zeros(apart.shape, bool)
    np.put_along_axis(home, order, (before < k) & (size[order] > 0), axis=1)
    return home


def reachable(apart: np.ndarray, radius: np.ndarray, size: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which groups may hold a vector that scores ``edge`` or more (``query x group``)."""
    best = np.cos(np.maximum(0.0, apart - radius - SLACK))
    return (best + 10.0**-SCORE_DIGITS >= edge[:, None]) & (size > 0)


def nearest(
    index: Grouped | None,
    queries: DataFrame | QueryVectors,
    k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """What ``knn.nearest`` gives over the grouped vectors, without reading the groups out of reach."""
    asked = queries if isinstance(queries, QueryVectors) else query_vectors(queries, query_keys, vector_col)
    keys = list(asked.keys)
    id_type = index.rows.schema["_id"].dataType if index is not None else T.LongType()
    fields = [T.StructField(c, asked.frame.schema[c].dataType) for c in keys]
    out = T.StructType([*fields, T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    found = [] if index is None else [hits for rows in blocks_of(asked) for hits in _block(index, rows, keys, k, out)]
    if not found:
        return asked.frame.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(1))
    return best_hits(reduce(DataFrame.unionByName, found), keys, id_col, k)


def _block(index: Grouped, head: pa.Table, keys: list[str], k: int, out: T.StructType) -> list[DataFrame]:
    if not head.num_rows:
        return []
    matrix = np.array(head.column("_qvec").to_pylist(), dtype=float)
    if matrix.shape[1] != index.centres.shape[1]:
        return []
    matrix = unit(matrix)
    apart = angles(matrix, index.centres)
    home = home_groups(apart, index.size, k)
    first = materialize(_scored(index, head, matrix, home, np.full(len(matrix), -np.inf), keys, k, out))
    edge = _edges(best_hits(first, keys, out.names[-2], k), head, keys, k)
    rest = reachable(apart, index.radius, index.size, edge) & ~home
    if not rest.any():
        return [first]
    return [first, materialize(_scored(index, head, matrix, rest, edge, keys, k, out))]


def _edges(hits: DataFrame, head: pa.Table, keys: list[str], k: int) -> np.ndarray:
    """The ``k``-th best score of every query so far; no bound for one with fewer hits."""
    rows = hits.where(F.col("rank") == k).select(*keys, "score").collect()  # one row per query of the block
    known = {tuple(r[:-1]): r["score"] for r in rows}
    return np.array([known.get(key, -np.inf) for key in zip(*[head.column(c).to_pylist() for c in keys])])


def _scored(
    index: Grouped, head: pa.Table, matrix: np.ndarray, wanted: np.ndarray, edge: np.ndarray, keys: list[str], k: int, out: T.StructType
) -> DataFrame:
    """Hits of the wanted (query, group) cells; other groups are not read."""
    key_rows = list(zip(*[head.column(c).to_pylist() for c in keys]))
    key_types = [head.schema.field(c).type for c in keys]
    start, merge = _make_scorer(k)
    groups = np.flatnonzero(wanted.any(axis=0)).tolist()
    names = out.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, reach = start(len(key_rows))
        reach = np.maximum(reach, edge)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            block = np.asarray(batch.column(1).flatten(), dtype=float).reshape(batch.num_rows, matrix.shape[1])
            ids, group = batch.column(0).to_pylist(), np.asarray(batch.column(2))
            for g in np.unique(group):
                asking, at = np.flatnonzero(wanted[:, g]), np.flatnonzero(group == g)
                if len(asking):
                    part, limit = [best[q] for q in asking], reach[asking]
                    merge((part, limit), matrix[asking], [ids[i] for i in at], block[at])
                    for q, kept, low in zip(asking, part, limit):
                        best[q], reach[q] = kept, max(low, reach[q])
        rows = [(key_rows[q], i, -s) for q, kept in enumerate(best) for s, i in kept]
        if rows:
            columns = [pa.array([r[0][c] for r in rows], t) for c, t in enumerate(key_types)]
            columns += [pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return index.rows.where(F.col("_group").isin(groups)).mapInArrow(score, out)
