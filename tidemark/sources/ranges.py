"""Time intervals, pages, id ranges and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import page_of, with_neighbour, with_position, with_running

PAGE_SIZE = 20
FIRST_POLL_ITEMS = 150  # fixed value
RANGE_STEP = 10_000  # ids one row holds while a range is unfolded


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def split_intervals(bounds: DataFrame, n: int, start: str = "start", end: str = "end", gap: bool = False) -> DataFrame:
    """``n`` equal intervals per bounds row. Half-open by default; with ``gap`` all but the last end a minute early."""
    length = (_micros(F.col(end)) - _micros(F.col(start))) / F.lit(n)
    i = F.col("interval_no")
    low = _micros(F.col(start)) + F.round(i * length).cast("bigint")
    high = _micros(F.col(start)) + F.round((i + 1) * length).cast("bigint")
    if gap:
        high = F.when(i + 1 == n, high).otherwise(high - F.lit(60_000_000))
    return bounds.withColumn("interval_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "*", F.timestamp_micros(low).alias("interval_start"), F.timestamp_micros(high).alias("interval_end")
    )


def interval_of(ts: Column, start: Column, end: Column, n: int, gap: bool = False) -> Column:
    """Number of the interval that holds ``ts``, by arithmetic and not by a range join; null outside (or in a gap)."""
    offset = _micros(ts) - _micros(start)
    total = _micros(end) - _micros(start)
    near = F.least(F.floor(offset * F.lit(n) / total), F.lit(n - 1)).cast("bigint")
    edge = lambda i: F.round(i * (total / F.lit(n))).cast("bigint")  # noqa: E731  the rounded edges of split_intervals
    number = F.when(offset < edge(near), near - 1).when((offset >= edge(near + 1)) & (near < n - 1), near + 1).otherwise(near)
    inside = (offset >= 0) & (offset <= total)
    if gap:
        closes = edge(number + 1) - F.lit(60_000_000)
        inside = inside & ((number == n - 1) | (offset <= closes))
    return F.when(inside, number)


def paged(df: DataFrame, ts: str, row_id: str, size: int = PAGE_SIZE) -> DataFrame:
    """0-based page of every row in ``(ts, row_id)`` order, numbered without a single-task window."""
    placed = with_position(df, [ts, row_id])
    return placed.withColumn("page", page_of(F.col("pos"), size)).drop("_slice")


def next_page(df: DataFrame, ts: str, row_id: str, after: tuple[Column, Column] | None, size: int = PAGE_SIZE):
    """Keyset paging: the ``size`` rows that follow the last ``(ts, row_id)`` seen."""
    if after is not None:
        last_ts, last_id = after
        df = df.where((F.col(ts) > last_ts) | ((F.col(ts) == last_ts) & (F.col(row_id) > last_id)))
    return df.orderBy(ts, row_id).limit(size)


def split_keys(positioned: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Consecutive, equally long shares of a key list; no key is lost."""
    total = positioned.agg(F.max(pos) + 1).scalar()
    return positioned.withColumn("worker", F.floor(F.col(pos) * F.lit(n) / total).cast("bigint"))


def poll_ranges(
    polls: DataFrame, poll_ts: str = "poll_ts", max_id: str = "max_id", before: int | None = None
) -> DataFrame:
    """Every poll with the half-open id range it adds. The first one continues at ``before``, or without it takes the
    last 150 ids."""
    lagged = with_neighbour(with_position(polls, [poll_ts, max_id]), [], {"previous": max_id}, step=-1)
    opening = F.lit(before).cast("bigint") if before is not None else F.col(max_id) - F.lit(FIRST_POLL_ITEMS)
    return lagged.select(
        poll_ts, F.col(max_id), F.coalesce("previous", opening).alias("low"), F.col(max_id).alias("high")
    )


def unfold_ranges(ranges: DataFrame, keep: Sequence[str], low: str = "low", high: str = "high", name: str = "item_id"):
    """One row per id. Long ranges are cut into steps and dealt out first, so that no row unfolds without bound."""
    steps = ranges.where(F.col(high) > F.col(low)).select(
        *keep, high, F.explode(F.sequence(F.col(low), F.col(high) - 1, F.lit(RANGE_STEP))).alias("_from")
    )
    dealt = steps.repartition(F.col("_from"))
    last = F.least(F.col("_from") + F.lit(RANGE_STEP), F.col(high)) - 1
    return dealt.select(*keep, F.explode(F.sequence(F.col("_from"), last)).alias(name))


def batch_numbers(
    df: DataFrame, key: str, ts: str, row_id: str, max_items: int = 100, max_gap_seconds: float = 0.5
) -> DataFrame:
    """``batch_no`` per key: a batch closes after a pause longer than the gap, or when it is full."""
    placed = with_neighbour(with_position(df, [key, ts, row_id]), [key], {"_before": ts}, step=-1)
    pause = (_micros(F.col(ts)) - _micros(F.col("_before"))) / F.lit(1e6)
    opens = F.col("_before").isNull() | (pause > F.lit(max_gap_seconds))
    # position of the row that opened the run this row belongs to
    runs = with_running(placed, [key], F.when(opens, F.col("pos")), "_opened", "max")
    opens_batch = F.pmod(F.col("pos") - F.col("_opened"), F.lit(max_items)) == 0
    numbered = with_running(runs, [key], opens_batch.cast("bigint"), "batch_no", "sum")
    return numbered.withColumn("batch_no", F.col("batch_no") - 1).drop("_before", "_opened", "_slice", "pos")
