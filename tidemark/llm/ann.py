"""Nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to a centre, scaled to length one and rotated at random; the code is the sign of each
coordinate. The inner product of the code with a rotated query, divided by the code's inner product with its own vector,
estimates the inner product of the vectors without bias, and a bound on the error follows from that correction scalar.
Only vectors whose bound reaches below the best exact distances so far are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map
from tidemark.session import materialize

FIT_ROWS = 10_000  # vectors that give the centre and the number of dimensions
QUERY_BLOCK = 4096  # queries sent to the tasks at a time
QUERY_STEP = 128
EPSILON = 3.0  # the bound fails with a probability that falls as exp(-c * EPSILON ** 2)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: str) -> F.Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def encode(matrix: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances to the centre and correction scalars of the rows of a matrix."""
    moved = matrix - centre
    length = np.sqrt((moved * moved).sum(axis=1))
    turned = (moved / np.where(length == 0, 1, length)[:, None]) @ turn
    return np.packbits(turned >= 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(matrix.shape[1])


class Index:
    """Code table ``vec_id, vector, code, length, scalar`` with the centre and rotation it was made with."""

    def __init__(self, rows: DataFrame, centre: np.ndarray, turn: np.ndarray):
        self.rows, self.centre, self.turn = rows, centre, turn


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> Index | None:
    """Index of all usable vectors; None when there is none.

    Centre and dimension come from the ``FIT_ROWS`` vectors whose hashed id is smallest; every row is indexed. Vectors
    that are null, zero, of another dimension or hold a null or non-finite component, and rows without an id, are left
    out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(usable("vector") & F.col("vec_id").isNotNull())
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(FIT_ROWS).select("vector").collect()
    if not sample:
        return None
    sizes = np.bincount([len(r["vector"]) for r in sample])
    dim = int(sizes.argmax())
    centre = np.mean([r["vector"] for r in sample if len(r["vector"]) == dim], axis=0)
    turn = rotation(dim, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                matrix = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                code, length, scalar = encode(matrix, centre, turn)
                yield {"vec_id": batch.column(0), "vector": batch.column(1), "code": [c.tobytes() for c in code], "length": length, "scalar": scalar}

    coded = arrow_map(rows.filter(F.size("vector") == dim), run, "vec_id long, vector array<double>, code binary, length double, scalar double")
    return Index(materialize(coded), centre, turn)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of every query, each id once, ties to the smaller id."""
    order = np.lexsort((score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])] if len(query) else np.zeros(0, bool)
    query, ids, score = query[new], ids[new], score[new]
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return query[place < k], ids[place < k], score[place < k]


def exact(queries: np.ndarray, matrix: np.ndarray, q: np.ndarray, o: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    out = np.empty(len(q))
    for i in range(0, len(q), step):
        gap = queries[q[i : i + step]] - matrix[o[i : i + step]]
        out[i : i + step] = np.sqrt((gap * gap).sum(axis=1))
    return out


def scan(batches: Iterator[pa.RecordBatch], block, k: int, epsilon: float) -> Iterator[dict]:
    """Best candidates of a task for a block of queries."""
    ids, queries, centre, turn = block.value
    dim = queries.shape[1]
    moved = queries - centre
    length = np.sqrt((moved * moved).sum(axis=1))
    turned = ((moved / np.where(length == 0, 1, length)[:, None]) @ turn).astype(np.float32)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    reach = np.full(len(ids), np.inf)  # distance of the k-th best so far
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.asarray(batch.column(0))
        matrix = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
        codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
        far, scalar = np.asarray(batch.column(3)), np.asarray(batch.column(4))
        scalar = np.where(scalar == 0, 1, scalar)
        slack = np.sqrt(np.maximum(0, 1 - scalar**2)) / scalar * (epsilon / np.sqrt(max(1, dim - 1)))
        for at in range(0, len(ids), QUERY_STEP):
            part = np.arange(at, min(len(ids), at + QUERY_STEP))
            inner = (turned[part] @ signs.T) / (np.sqrt(dim) * scalar)
            square = far**2 + length[part, None] ** 2
            spread = 2 * far * length[part, None]
            other = ids[part, None] != own
            if np.isinf(reach[part]).any():  # first bounds from the best estimates
                guess = np.where(other, square - spread * inner, np.inf)
                near = np.argpartition(guess, min(k, guess.shape[1]) - 1, axis=1)[:, :k]
                q, o = np.repeat(part, near.shape[1]), near.ravel()
                fine = ids[q] != own[o]
                held, reach = merged(held, reach, q[fine], own[o[fine]], exact(queries, matrix, q[fine], o[fine]), k)
            low = square - spread * np.minimum(1, inner + slack)
            q, o = np.nonzero(other & (low <= (reach[part] ** 2 * (1 + 1e-9) + 1e-12)[:, None]))
            held, reach = merged(held, reach, part[q], own[o], exact(queries, matrix, part[q], o), k)
    yield {"query_id": ids[held[0]], "vec_id": held[1], "score": held[2]}


def merged(held, reach, q, ids, score, k):
    close = score <= reach[q]
    held = best(*(np.concatenate([a, b[close]]) for a, b in zip(held, (q, ids, score), strict=True)), k)
    count = np.bincount(held[0], minlength=len(reach))
    last = np.cumsum(count) - 1
    full = count >= k
    reach = np.full(len(reach), np.inf)
    reach[full] = held[2][last[full]]
    return held, reach


def search(index: Index | None, queries: DataFrame, k: int = 10, epsilon: float = EPSILON, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest vectors of every query row of the index.

    ``queries``: rows of the index's table. ``score`` is the Euclidean distance of the original vectors in double
    precision. A query's own id is no candidate; an id that occurs in several rows is found once, with its nearest row.
    Queries travel in blocks of about ``block``; each block meets the code table where it lies, every task sends ``k`` rows
    per query, and these are merged in two steps.
    """
    spark = queries.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // block))
    results = []
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(blocks)) == number).orderBy("vec_id").collect()
        if not rows:
            continue
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        sent = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in rows], np.float64), index.centre, index.turn))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[dict]:
            yield from scan(batches, sent, k, epsilon)

        hits = arrow_map(index.rows.select("vec_id", "vector", "code", "length", "scalar"), run, "query_id long, vec_id long, score double")
        hits = top(hits.withColumn("part", F.spark_partition_id() % 64), k, "query_id", "part")
        results.append(materialize(top(hits.drop("part"), k, "query_id")))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.select("query_id", F.row_number().over(place).cast("int").alias("rank"), "vec_id", "score")


def top(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    once = hits.groupBy(*keys, "vec_id").agg(F.min("score").alias("score"))
    place = Window.partitionBy(*keys).orderBy("score", "vec_id")
    return once.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k).drop("_place")
