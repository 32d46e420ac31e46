"""Windows over long ordered groups, without one task per group.

``Window.partitionBy(key)`` puts a whole key in one task, and a key may hold a third of the table. The functions here
number the rows of a total order instead: one range-partitioned sort (equal slices whatever the keys are), stored once,
plus one small row per slice. One exchange then sends every slice to a task of its own, by its number and not by a hash of
it; windows work inside the slice, and the row per slice tells what lies beyond its edges: the neighbour, or what earlier
slices carry over. Several such windows share the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

SLICE = "_slice"
SLICE_ROWS = 100_000  # a slice holds about as many rows, however long the table is
_LOW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits, the partition above
_COUNT, _DEALT = "slices", "dealt"  # metadata of the slice column: how many there are, whether each has its task


def _slice(**notes) -> Column:
    return F.col(SLICE).alias(SLICE, metadata=notes)


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Add the dense 0-based position in ``order``, which must be total (end it with a unique column)."""
    slices = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SLICE_ROWS))
    ordered = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    stored = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()))
    sliced = stored.withColumn(SLICE, F.shiftright("_mid", _LOW_BITS).cast("int"))
    sizes = sorted(tuple(r) for r in sliced.groupBy(SLICE).count().collect())  # one row per sort partition
    starts = accumulate((n for _, n in sizes), initial=0)
    first = df.sparkSession.createDataFrame([(s, at) for (s, _), at in zip(sizes, starts)], f"{SLICE} int, _start long")
    offset = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    placed = sliced.join(F.broadcast(first), SLICE).withColumn(name, F.col("_start") + offset).drop("_mid", "_start")
    return placed.withColumn(SLICE, _slice(**{_COUNT: sizes[-1][0] + 1 if sizes else 1}))


def dealt(positioned: DataFrame) -> DataFrame:
    """Every slice in a task of its own; rows that are dealt already stay where they are."""
    notes = positioned.schema[SLICE].metadata
    if notes.get(_DEALT):
        return positioned
    count = notes.get(_COUNT)
    out = positioned.repartitionById(count, SLICE) if count else positioned.repartition(SLICE)
    return out.withColumn(SLICE, _slice(**notes, **{_DEALT: True}))


def _key(keys: Sequence[str]) -> Column:
    return F.struct(F.lit(0).alias("_"), *keys)


def with_neighbour(
    positioned: DataFrame, keys: Sequence[str], columns: dict[str, str], step: int = 1, pos: str = "pos"
) -> DataFrame:
    """Lead (``step=1``) or lag (``step=-1``) of ``columns`` (new name -> source) inside ``keys``, which lead the order."""
    if step not in (1, -1):
        raise ValueError("a neighbour is one step away")
    shifted, end = (F.lead, F.min_by) if step == 1 else (F.lag, F.max_by)
    row = F.struct(_key(keys).alias("key"), *[F.col(src).alias(new) for new, src in columns.items()])
    edges = (  # what lies just beyond each slice
        positioned.groupBy(SLICE)
        .agg(end(row, F.col(pos)).alias("_edge"))
        .select(SLICE, shifted("_edge").over(Window.orderBy(SLICE)).alias("_edge"))
    )
    inside = Window.partitionBy(SLICE).orderBy(pos)
    joined = dealt(positioned).withColumn("_near", shifted(row).over(inside)).join(F.broadcast(edges), SLICE, "left")
    near = joined.withColumn("_near", F.coalesce("_near", "_edge"))
    same = F.col("_near.key").eqNullSafe(_key(keys))
    return near.withColumns({new: F.when(same, F.col("_near")[new]) for new in columns}).drop("_near", "_edge")


def with_running(
    positioned: DataFrame, keys: Sequence[str], value: Column, name: str, how: str = "sum", pos: str = "pos"
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (that is not null) of ``value`` per key, up to and including the row itself.

    ``keys`` lead the order, so only the last key of a slice goes on in the next one.
    """
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    combine = {
        "sum": lambda carry, here: F.coalesce(carry + here, carry, here),
        "max": F.greatest,
        "last": lambda carry, here: F.coalesce(here, carry),
    }[how]
    inside = Window.partitionBy(SLICE, *keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = positioned.groupBy(SLICE).agg(F.max_by(_key(keys), F.col(pos)).alias("_end"))  # one key per slice
    last = positioned.withColumn("_value", value).join(F.broadcast(ends), SLICE).where(F.col("_end").eqNullSafe(_key(keys)))
    whole = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(pos))) if how == "last" else fold("_value")
    tails = last.groupBy(SLICE).agg(F.any_value("_end").alias("_end"), whole.alias("_tail"))
    along = Window.partitionBy("_end").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carries = tails.select(SLICE, F.struct("_end", fold("_tail").over(along).alias("value")).alias("_sum")).select(
        SLICE, F.lag("_sum").over(Window.orderBy(SLICE)).alias("_carry")
    )
    carry = F.when(F.col("_carry._end").eqNullSafe(_key(keys)), F.col("_carry.value"))
    return (
        dealt(positioned)
        .withColumn("_value", value)
        .withColumn("_so_far", fold("_value").over(inside))
        .join(F.broadcast(carries), SLICE, "left")
        .withColumn(name, combine(carry, F.col("_so_far")))
        .drop("_value", "_so_far", "_carry")
    )


def with_row_number(positioned: DataFrame, keys: Sequence[str], name: str = "rn", pos: str = "pos") -> DataFrame:
    """1-based row number per key in the stored order."""
    return with_running(positioned, keys, F.lit(1), name, "sum", pos)


def page_of(position: Column, size: int) -> Column:
    """0-based page of a 0-based position."""
    return F.floor(position / F.lit(size)).cast("bigint")
