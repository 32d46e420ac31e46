"""Sharding by sampled splitters.

A size-weighted sample of the keys gives quantile boundaries; rows are dealt to the ranges between them, and a range
that turns out overfull is sampled and divided again. The key of a row is (hash of its text, id), so equal texts lie side
by side, and a group of copies larger than a range is divided by id. Exact range totals then give every row its place in
the order of all rows, and the shard that covers this place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map
from tidemark.session import materialize

ROWS = "doc_id long, size long, text_crc32 long, key long, tie long"
MAX_ROUNDS = 12


def weighted_draw(size: Column, *key: Column, seed: int) -> Column:
    """Exponential draw with rate ``size``: the rows with the smallest draws are a size-weighted sample without
    replacement. It depends on the row alone, so a task that runs again draws the same."""
    u = (F.xxhash64(F.lit(seed), *key).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.greatest(size, F.lit(1)).cast("double")


def sortable(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Byte strings that sort as the signed pairs (key, tie)."""
    flip = np.uint64(1 << 63)
    pair = np.stack([keys.astype(np.int64).view(np.uint64) ^ flip, ties.astype(np.int64).view(np.uint64) ^ flip], axis=1)
    return np.frombuffer(pair.astype(">u8").tobytes(), "S16")


def dealt(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``: the number of boundaries that are not above the row's key. The boundaries are a bounded list."""
    edges = sortable(np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keys = sortable(b.column(3).to_numpy(), b.column(4).to_numpy())
            columns = {name: b.column(i) for i, name in enumerate(b.schema.names[:5])}
            yield columns | {"range": np.searchsorted(edges, keys, side="right")}

    return arrow_map(rows, run, f"{ROWS}, range int")


def splitters(rows: DataFrame, ranges: int, per_range: int = 8, overfull: float = 2.0, seed: int = 0) -> list[tuple[int, int]]:
    """Boundaries (key, tie) of ranges that each hold at most ``overfull / ranges`` of all bytes and of all rows, but for
    single keys. At most ``ranges * per_range`` sampled keys come to the driver in a round."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    most = [max(1.0, overfull * total / ranges), max(1.0, overfull * count / ranges)]

    def sample(part: DataFrame, n: int, round_: int) -> list[tuple[int, int]]:
        draw = weighted_draw(F.col("size"), F.col("key"), F.col("tie"), seed=seed + round_)
        taken = part.select("key", "tie", draw.alias("draw")).orderBy("draw").limit(n).collect()
        return sorted({(r["key"], r["tie"]) for r in taken})

    first = sample(rows, ranges * per_range, 0)
    bounds = sorted({first[i * len(first) // ranges] for i in range(1, ranges)}) if first else []
    for round_ in range(1, MAX_ROUNDS):
        with_range = dealt(rows, bounds)
        held = with_range.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        full = held.filter((F.col("n") > 1) & ((F.col("b") > most[0]) | (F.col("n") > most[1])))
        full = {r["range"]: max(r["b"] / most[0], r["n"] / most[1]) for r in full.collect()}
        if not full:
            break
        # Rows that are small but many need draws by count: every row of an overfull range weighs the same here.
        part = with_range.filter(F.col("range").isin(list(full)))
        by_rows = part.withColumn("size", F.lit(1)) if round_ % 2 == 0 else part
        more = sample(by_rows, min(int(sum(full.values()) * per_range * 2) + 16, ranges * per_range), round_)
        inside: dict[int, list] = {r: [] for r in full}
        edges = np.searchsorted(
            sortable(np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])),
            sortable(np.array([m[0] for m in more]), np.array([m[1] for m in more])),
            side="right",
        ) if bounds else [0] * len(more)
        for key, r in zip(more, edges, strict=True):
            inside.setdefault(int(r), []).append(key)
        added = set()
        for r, keys in inside.items():
            pieces = int(2 * full.get(r, 0)) + 1
            added |= {keys[i * len(keys) // pieces] for i in range(1, pieces)} if keys else set()
        if not added - set(bounds):
            break
        bounds = sorted(set(bounds) | added)
    return bounds


def shard(
    docs: DataFrame,
    shards: int = 24,
    law: str = "bytes",
    overhead: int = 8,
    rows_per_range: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the number of UTF-8 bytes of the text plus ``overhead``; a null text has none, and CRC 0. Law ``bytes``
    makes the shards' sizes differ by less than two rows; law ``rows`` makes their row counts differ by at most one.
    ``slot`` numbers the rows of a shard from 0. ``grown_shard`` is null: both laws move rows when a shard is added.
    Repeated rows (equal id and text) are kept and told apart by their number among themselves. A null id sorts below all
    others. An empty table gives no rows. Only numbers are shuffled, never a text.
    """
    if law not in ("bytes", "rows"):
        raise ValueError("law is bytes or rows")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ).withColumn("tie", F.coalesce("doc_id", F.lit(-(1 << 63))))
    )
    ranges = max(shards * 16, -(-rows.count() // rows_per_range))
    placed = dealt(rows, splitters(rows, ranges, seed=seed))
    held = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = held.select(
        "range",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
    )
    total, count = held.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    order = Window.partitionBy("range").orderBy("key", "tie", "size", "text_crc32")
    seen = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.join(F.broadcast(base) if ranges <= 100_000 else base, "range").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("row"),
        (F.col("bytes_before") + F.sum("size").over(seen) - F.col("size")).alias("byte"),
    )
    if law == "rows":
        per, more = divmod(count, shards)
        edge = more * (per + 1)
        cut = F.when(F.col("row") < edge, F.expr(f"row div {per + 1}")).otherwise(
            F.expr(f"{more} + (row - {edge}) div {max(1, per)}")
        )
    else:
        cut = F.least(F.expr(f"cast(floor((byte + size / 2.0D) * {shards} / {max(1, total)}) as long)"), F.lit(shards - 1))
    at = materialize(at.withColumn("shard", cut.cast("int")))
    first = at.groupBy("shard").agg(F.min("row").alias("first_row"))
    return at.join(F.broadcast(first), "shard").select(  # at most ``shards`` rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
