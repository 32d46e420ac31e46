"""Exact nearest neighbours and diversified top-k.

The chunk table is streamed once where it lies. Each task scores its Arrow batches against the whole query matrix and
keeps only the best ``k`` per query, so what reaches the shuffle is ``k`` rows per query and task, never the pairs.
A query table that is too long for that is cut into blocks; a task holds one block and reads all chunks past it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import let
from tidemark.functions.vectors import cosine
from tidemark.session import materialize

MAX_QUERY_VECTORS = 4096  # query vectors shipped to every task; 4096 x 384 doubles are 12 MB
TASKS_PER_MERGE = 256  # scoring tasks whose hits are merged before the last step
BROADCAST_HITS = 200_000  # hit rows (ids and scores) that may be broadcast
SCORES_AT_ONCE = 2_000_000  # scores a task holds while it works through a batch, 16 MB
TILE_VALUES = 1 << 20  # vector components of a block of queries, 8 MB as doubles
TILE_GROUP = 32  # neighbouring scores of which the best is looked at first
TASKS_PER_CORE = 4  # tasks that a long query table is dealt to at least,
SHORT_BLOCK = 2048  # unless their blocks had fewer queries
TILE_CHUNKS = 1024  # chunks that are scored at a time, against
TILE_QUERIES = 256  # queries: the scores stay in a core's cache
SCORE_DIGITS = 9  # equal vectors tie whichever batch they were scored in


def _make_scorer(k: int):
    """Closure over plain values only, so that workers need numpy but not this package."""
    digits, scores_at_once = SCORE_DIGITS, SCORES_AT_ONCE

    def start(n):
        """State of ``n`` queries: per query the best (-score, id), sorted, and the score a newcomer has to reach."""
        import numpy as np

        return [[] for _ in range(n)], np.full(n, -np.inf)

    def merge(state, matrix, ids, vectors):
        """Take a block of vectors into the state; the scores held at a time are bounded."""
        import heapq

        import numpy as np

        best, edge = state
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        rows = np.nonzero(lengths > 0)[0]
        step = max(1, scores_at_once // len(best))
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            scores = np.round((vectors[part] / lengths[part, None]) @ matrix.T, digits)
            for q in np.nonzero(scores.max(axis=0) >= edge)[0]:
                column = scores[:, q]
                limit = edge[q]
                if len(column) > k:
                    limit = max(limit, np.partition(column, len(column) - k)[len(column) - k])
                found = [(-float(column[r]), ids[part[r]]) for r in np.nonzero(column >= limit)[0]]
                best[q] = heapq.nsmallest(k, best[q] + found)
                if len(best[q]) == k:
                    edge[q] = -best[q][-1][0]

    return start, merge


@dataclass(frozen=True)
class QueryVectors:
    """Query vectors with, when they fit a task, their rows at hand; else a search by groups takes about ``block`` at a time."""

    frame: DataFrame
    keys: tuple[str, ...]
    rows: pa.Table | None
    block: int

    def max_hits(self, k: int) -> int | None:
        """Proven bound on the hits of a top-k, None when the query table is large."""
        return None if self.rows is None else self.rows.num_rows * k


def query_vectors(
    queries: DataFrame,
    keys: Sequence[str] = ("query_id",),
    vector_col: str = "embedding",
    at_most: int = MAX_QUERY_VECTORS,
) -> QueryVectors:
    """Read at most ``at_most`` query vectors; a longer table stays distributed."""
    asked = queries.where(F.col(vector_col).isNotNull()).select(
        *keys, F.col(vector_col).cast("array<double>").alias("_qvec")
    )
    head = asked.limit(at_most + 1).toArrow()
    return QueryVectors(asked, tuple(keys), head if head.num_rows <= at_most else None, at_most)


def nearest(
    chunks: DataFrame,
    queries: DataFrame | QueryVectors,
    k: int,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """The ``k`` best chunks of every query vector by cosine, ties broken by id: query keys, id, ``score``, ``rank``.

    ``chunks`` holds one row per id; filter it first, filters belong below the top-k. Rows without a usable vector match
    nothing. Up to ``MAX_QUERY_VECTORS`` vectors are sent to the tasks; a longer query table, which is read twice, is dealt to
    tasks in blocks, and each task reads the chunks, without a pass through the driver.
    """
    asked = queries if isinstance(queries, QueryVectors) else query_vectors(queries, query_keys, vector_col)
    keys = list(asked.keys)
    pool = chunks.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(vector_col).alias("_vec")  # as stored; tasks widen to double
    )
    out = T.StructType(
        [
            *[T.StructField(c, asked.frame.schema[c].dataType) for c in keys],
            T.StructField(id_col, pool.schema["_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if asked.rows is None:
        hits = _against_blocks(pool, asked.frame, keys, k, out)  # a query's hits are one task's or a few tasks'
        return top_k(hits, keys, [F.col("score").desc(), F.col(id_col)], k)
    return best_hits(_against_matrix(pool, asked.rows, keys, k, out), keys, id_col, k)


def best_hits(hits: DataFrame, keys: Sequence[str], id_col: str, k: int) -> DataFrame:
    """The ``k`` best of every query, merged for some tasks first, so that no task takes the hits of all others."""
    best = [F.col("score").desc(), F.col(id_col)]
    merged = hits.withColumn("_part", F.floor(F.spark_partition_id() / F.lit(TASKS_PER_MERGE)))
    merged = top_k(merged, [*keys, "_part"], best, k).drop("_part", "rank")
    return top_k(merged, keys, best, k)


def blocks_of(asked: QueryVectors) -> Iterator[pa.Table]:
    """The query vectors as Arrow tables of about ``block`` rows, one at a time on the driver."""
    if asked.rows is not None:
        yield asked.rows
        return
    blocks = max(1, -(-asked.frame.count() // asked.block))
    number = F.pmod(F.xxhash64(*asked.keys), F.lit(blocks))
    for block in range(blocks):
        yield asked.frame.where(number == block).toArrow()


def _against_matrix(pool: DataFrame, head: pa.Table, keys: list[str], k: int, out: T.StructType) -> DataFrame:
    import numpy as np

    key_rows = list(zip(*[head.column(c).to_pylist() for c in keys]))
    key_types = [head.schema.field(c).type for c in keys]
    matrix = np.array(head.column("_qvec").to_pylist(), dtype=float)
    if not key_rows:
        return pool.sparkSession.createDataFrame([], out)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    start, merge = _make_scorer(k)
    names = out.names

    def score(batches):
        import numpy as np
        import pyarrow as pa

        state = start(len(key_rows))
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            if batch.num_rows == 0:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            block = np.asarray(flat, dtype=float).reshape(batch.num_rows, matrix.shape[1])
            merge(state, matrix, batch.column(0).to_pylist(), block)
        rows = [(key_rows[q], i, -s) for q, kept in enumerate(state[0]) for s, i in kept]
        if rows:
            columns = [pa.array([r[0][c] for r in rows], t) for c, t in enumerate(key_types)]
            columns += [pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pool.where(F.size("_vec") == matrix.shape[1]).mapInArrow(score, out)


def _against_blocks(pool: DataFrame, asked: DataFrame, keys: list[str], k: int, out: T.StructType) -> DataFrame:
    """Hits of a long query table. The queries are dealt once to blocks of equal size, whatever the keys are; a task holds one
    block, reads all chunks where they are stored, and keeps ``k`` rows per query. So neither pairs nor hits of parts are
    exchanged. Only with fewer blocks than tasks the chunks are cut too. Vectors of different lengths do not meet.

    A task gets its block as one row, which only the first row of its chunks meets; the others meet a row without it.
    """
    pool = materialize(pool).withColumn("_dim", F.size("_vec")).where("_dim > 0")
    size = asked.agg(F.count(F.lit(1)), F.max(F.size("_qvec"))).first()
    longest = max(1, TILE_VALUES // max(k, size[1] or 1))
    tasks = TASKS_PER_CORE * pool.sparkSession.sparkContext.defaultParallelism
    rows = min(longest, max(SHORT_BLOCK, -(-size[0] // tasks)))
    blocks = max(1, -(-size[0] // rows))

    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = asked.withColumn("_q", number).repartitionById(blocks, "_q").withColumn("_dim", F.size("_qvec"))
    block = dealt.groupBy("_q", "_dim").agg(F.collect_list(F.struct(*keys, "_qvec")).alias("_asked"))
    nothing = F.array().cast(block.schema["_asked"].dataType)  # not null: Arrow writers go back over all nulls at every row
    kinds = [F.struct(F.lit(kind).alias("_kind"), held.alias("_asked")) for kind, held in ((0, F.col("_asked")), (1, nothing))]
    right = block.select("_q", "_dim", F.inline(F.array(*kinds))).alias("q")

    part = pool.coalesce(-(-tasks // blocks))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the low 33 bits number a task's rows
    opened = F.when(first, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    left = part.withColumn("_kinds", opened).select("_id", "_vec", "_dim", F.explode("_kinds").alias("_kind")).alias("c")

    meet = (F.col("c._kind") == F.col("q._kind")) & ((F.col("c._kind") == 0) | (F.col("c._dim") == F.col("q._dim")))
    met = left.join(right.hint("shuffle_replicate_nl"), meet).select("_q", "q._dim", "_asked", "_id", "_vec")
    return met.mapInArrow(_make_block_scorer(k, keys, out.names), out)


def _make_block_scorer(k: int, keys: list[str], names: list[str]):
    """Closure over plain values only, as ``_make_scorer``: the ``k`` best of a task's chunks for each query of its block.

    Scores in single precision, with a bound on their error, choose the pairs that are scored in double precision.
    """
    digits, group, values = SCORE_DIGITS, TILE_GROUP, TILE_VALUES
    tile, step = TILE_CHUNKS, max(1, min(TILE_QUERIES, SCORES_AT_ONCE // TILE_CHUNKS))

    def unit_rows(column):
        """Rows of usable vectors and their vectors at length one."""
        import numpy as np

        flat = column.flatten().to_numpy(zero_copy_only=False)
        vectors = np.asarray(flat, dtype=float).reshape(len(column), -1)
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        rows = np.nonzero((lengths > 0) & np.isfinite(lengths))[0]
        return rows, vectors[rows] / lengths[rows, None]

    def first_copies(vectors):
        """Of equal vectors the first ``k``: what follows them ties and has a larger id."""
        import numpy as np

        bits = np.ascontiguousarray(vectors).view(np.uint64)
        mixed = (bits ^ (bits >> np.uint64(29))) @ np.random.default_rng(0).integers(1 << 63, size=bits.shape[1], dtype=np.uint64)
        _, at, times = np.unique(mixed, return_inverse=True, return_counts=True)
        alike = np.flatnonzero(times[at] > k)  # equal vectors have equal sums, so only these can have more than k copies
        if not len(alike):
            return np.arange(len(vectors))
        same = np.unique(vectors[alike], axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return np.delete(np.arange(len(vectors)), alike[order[nth >= k]])

    def start(block):
        """A block's keys and unit vectors; per query the score a newcomer has to have, and to have in single precision; the hits."""
        import numpy as np
        import pyarrow as pa

        rows, matrix = unit_rows(block.column("_qvec"))
        edge = np.full(len(rows), -np.inf)
        held = (np.zeros(0, np.int64), np.zeros(0), None)
        return [block.select(keys).take(pa.array(rows)), matrix, matrix.astype(np.float32), edge, edge.astype(np.float32), held]

    def merged(held, row, ids, value, queries):
        """Hits with the new ones taken in; of the queries that have ``k`` now and of the new hits, the score of the last."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        new = np.zeros(queries, bool)
        new[row] = True
        touched = new[held[0]]
        some = [held[2].filter(pa.array(touched)), ids] if held[2] is not None else [ids]
        row, value, ids = np.r_[held[0][touched], row], np.r_[held[1][touched], value], pa.concat_arrays(some)
        by = [("row", "ascending"), ("value", "descending"), ("id", "ascending")]
        order = pc.sort_indices(pa.table({"row": row, "value": value, "id": ids}), sort_keys=by).to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
        nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        last, order = order[nth == k - 1], order[nth < k]
        kept = (row[order], value[order], ids.take(pa.array(order)))
        if held[2] is not None:
            rest = ~touched
            kept = (np.r_[held[0][rest], kept[0]], np.r_[held[1][rest], kept[1]], pa.concat_arrays([held[2].filter(pa.array(rest)), kept[2]]))
        return kept, row[last], value[last]

    def take_in(state, ids, column):
        """Take a batch of chunks into the state of a block; the scores and pairs held at a time are bounded."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        _, matrix, short, edge, reach, _ = state
        by_id = pc.sort_indices(ids)
        ids, column = ids.take(by_id), column.take(by_id)
        rows, vectors = unit_rows(column)
        if not len(rows) or not len(matrix):
            return
        kept = first_copies(vectors)
        rows, vectors = rows[kept], vectors[kept]
        dim = vectors.shape[1]
        most = max(1, values // dim)
        slack = (dim + 8) * 2.0**-24 + 10.0**-digits  # of a product of unit vectors in single precision, and of rounding
        pairs, waiting = [], 0

        def lower(bound):
            return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))

        def settle():
            row, at = (np.concatenate(p) for p in zip(*pairs))
            for low in range(0, len(row), most):
                r, c = row[low : low + most], at[low : low + most]
                value = np.round(np.einsum("ij,ij->i", matrix[r], vectors[c]), digits)
                close = value >= edge[r]
                if close.any():
                    found = ids.take(pa.array(rows[c[close]]))
                    state[5], full, last = merged(state[5], r[close], found, value[close], len(matrix))
                    edge[full] = last
                    reach[full] = np.maximum(reach[full], lower(last - slack))

        for first in range(0, len(rows), tile):
            narrow = np.ascontiguousarray(vectors[first : first + tile].T, dtype=np.float32)
            whole = narrow.shape[1] // group * group
            for low in range(0, len(matrix), step):
                scores = short[low : low + step] @ narrow
                limit = reach[low : low + step]
                new = np.flatnonzero(np.isneginf(limit))
                if len(new) and whole // group >= k:  # as many groups hold a score at least as good as the k-th best of their bests
                    tops = scores[new, :whole].reshape(len(new), -1, group).max(axis=2)
                    limit[new] = lower(np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - 2 * slack)
                near = np.flatnonzero(scores.max(axis=1) >= limit)
                if not len(near):
                    continue
                row, at = np.nonzero(scores[near] >= limit[near, None])
                pairs.append((near[row] + low, at + first))
                waiting += len(row)
                if waiting >= most:
                    settle()
                    pairs, waiting = [], 0
        if pairs:
            settle()

    def score(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        blocks = {}
        for batch in batches:
            number, dim, asked, ids, vectors = batch.columns
            chunks = pc.list_value_length(asked).to_numpy() == 0
            for at in np.flatnonzero(~chunks):
                block = pa.RecordBatch.from_struct_array(asked[int(at)].values)
                blocks[number[int(at)].as_py(), dim[int(at)].as_py()] = start(block)
            of = np.stack([number.to_numpy(), dim.to_numpy()], axis=1)
            for block in np.unique(of[chunks], axis=0):
                rows = pa.array(np.flatnonzero(chunks & (of == block).all(axis=1)))
                take_in(blocks[tuple(block.tolist())], ids.take(rows), vectors.take(rows))
        for key_rows, *_, (row, value, ids) in blocks.values():
            if len(row):
                picked = key_rows.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*picked.columns, ids, pa.array(value)], names=names)

    return score


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark cuts each map task to ``k`` rows per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def attach_payload(
    hits: DataFrame, table: DataFrame, id_col: str = "chunk_id", how: str = "left", max_hits: int | None = None
) -> DataFrame:
    """Join hits to their rows, so that the top-k carries ids only. A hit without a row stays, with nulls.

    ``max_hits`` is a proven bound on the hit rows; within ``BROADCAST_HITS`` they travel to the table, not it to them. As
    an outer join cannot broadcast the side that it keeps whole, the hits are then stored and the wanted rows picked first.
    """
    if max_hits is None or max_hits > BROADCAST_HITS:
        return hits.join(table, id_col, how)
    if how == "inner":
        return F.broadcast(hits).join(table, id_col, how)
    hits = materialize(hits)
    return hits.join(table.join(F.broadcast(hits.select(id_col).distinct()), id_col, "left_semi"), id_col, how)


def union_hits(hits: DataFrame, keys: Sequence[str] = ("query_id", "chunk_id"), strict: bool = False) -> DataFrame:
    """Hits of all vectors of a query. A chunk met twice keeps its best score; ``strict`` keeps each distinct score."""
    if strict:
        return hits.select(*keys, "score").distinct()
    return hits.groupBy(*keys).agg(F.max("score").alias("score"))


def diversified(
    candidates: DataFrame,
    k: int = 3,
    weight: float = 0.5,
    query: str = "query_id",
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Maximal marginal relevance over a bounded candidate set per query (``nearest`` with ``fetch_k``).

    Each round takes the candidate with the best ``weight * score - (1 - weight) * similarity to the taken``. The rounds
    are one fold over an array of the query's ``fetch_k`` candidates; each candidate keeps its largest similarity to what
    has been taken, so a round compares it with the last one taken only: ``k * fetch_k`` similarities in all.
    """
    item = F.struct(
        F.col("score").alias("score"), F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.lit(None).cast("double").alias("near")
    )
    packed = candidates.groupBy(query).agg(F.collect_list(item).alias("_all"))

    def value(x: Column) -> Column:
        return F.round(F.lit(weight) * x["score"] - F.lit(1 - weight) * F.coalesce(x["near"], F.lit(0.0)), SCORE_DIGITS)

    def nearer(x: Column, last: Column) -> Column:
        similarity = F.round(cosine(last["vec"], x["vec"]), SCORE_DIGITS)
        return F.struct(x["score"].alias("score"), x["id"].alias("id"), x["vec"].alias("vec"), F.greatest(x["near"], similarity).alias("near"))

    def take_best(state: Column, _: Column) -> Column:
        order = F.transform(state["rest"], lambda x: F.struct((-value(x)).alias("order"), x["id"].alias("id")))
        return let(
            F.filter(state["rest"], lambda x: x["id"] == F.array_min(order)["id"]),
            lambda best: F.struct(
                F.concat(state["taken"], best).alias("taken"),
                F.transform(
                    F.filter(state["rest"], lambda x: ~F.exists(best, lambda b: b["id"] == x["id"])), lambda x: nearer(x, F.get(best, 0))
                ).alias("rest"),
            ),
        )

    start = F.struct(F.filter("_all", lambda x: F.lit(False)).alias("taken"), F.col("_all").alias("rest"))
    rounds = F.sequence(F.lit(1), F.lit(k))
    taken = F.aggregate(rounds, start, take_best, lambda state: state["taken"])
    return packed.select(query, F.posexplode(taken).alias("_p", "_t")).select(
        query, (F.col("_p") + 1).alias("rank"), F.col("_t.id").alias(id_col), F.col("_t.score").alias("score")
    )
