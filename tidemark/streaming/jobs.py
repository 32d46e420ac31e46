"""Streaming twins of the batch operators.

What a key shares over the life of a stream is either state of Spark's own operators, kept on disk and dealt by key after
the map tasks have aggregated, or a table of totals that is folded every few batches. A batch therefore reads a bounded
number of files, however many came before it, no key is bound to one worker, and a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ordered import with_position, with_row_number
from tidemark.session import widen
from tidemark.sources.ranges import poll_ranges
from tidemark.sources.sinks import upsert

POLL_FILINGS = "10 seconds"
POLL_ITEMS = "15 seconds"
NEWS_BATCH = "500 milliseconds"
FOLD = 16  # batches whose totals are added up into one table
STATE_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 1000
) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def start(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None
) -> StreamingQuery:
    """Run ``write`` on every micro-batch; without ``trigger`` the query stops when the input is used up."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    start(stream, write, checkpoint).awaitTermination()


def put_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def put_totals(rows: DataFrame, path: str, batch_id: int, key: str) -> None:
    """Store what a batch adds per key (``key, n``), and every ``FOLD`` batches the totals so far."""
    rows.write.mode("overwrite").parquet(f"{path}/added/{batch_id}")
    if (batch_id + 1) % FOLD == 0:
        sums = totals_before(rows.sparkSession, path, batch_id + 1, rows.schema, fold=False).groupBy(key).agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/whole/{batch_id}")


def totals_before(spark: SparkSession, path: str, batch_id: int, schema: T.StructType, fold: bool = True) -> DataFrame:
    """Rows ``key, n`` whose sums per key are the totals of all batches before: the last fold and at most ``FOLD`` batches
    after it, by their numbers, without a look at the folder."""
    last = (batch_id if fold else batch_id - 1) // FOLD * FOLD
    paths = [f"{path}/whole/{last - 1}"] if last else []
    paths += [f"{path}/added/{n}" for n in range(last, batch_id)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def ingest_writer(
    transform: Callable[[DataFrame], DataFrame], path: str, order: Sequence[str], dim: int | None = None, writer: str = "stream"
):
    """Endless ingest: transform the micro-batch to points and upsert them, the last of an id in ``order``. Streams into
    one collection differ in ``writer``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(transform(widen(batch)), path, batch_id, order, dim=dim, writer=writer)

    return write


def dedupe_within_watermark(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row per key; state is bounded by ``delay``, later copies pass again."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def only_keys_of(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The stored rows whose key occurs in the batch: the batch's keys travel to the long table, not it to them."""
    asked = batch.select(F.col(key).alias("_asked")).distinct()
    return stored.join(asked, F.col(key).eqNullSafe(F.col("_asked")), "left_semi")


def first_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key over the whole stream, however late a copy comes: of the batch that first holds the key the
    row that is first in ``order``. Run it in ``update`` mode, as ``drain_updates`` does.

    Spark keeps one row per key as state, dealt by key; map tasks send one row per key and batch. The time of a batch, which
    a replay keeps, tells the keys that it has brought.
    """
    rest = [c for c in stream.columns if c not in keys]
    stamped = stream.withColumn("_batch", F.current_timestamp())
    first = F.min_by(F.struct(*rest, F.lit(1).alias("_")), F.struct("_batch", *order))
    state = stamped.groupBy(*keys).agg(first.alias("_first"), F.min("_batch").alias("_born"))
    return state.where(F.col("_born") == F.current_timestamp()).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def drain_updates(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """``drain`` for aggregated state, which is kept on disk."""
    key, spark = "spark.sql.streaming.stateStore.providerClass", stream.sparkSession
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_ON_DISK)
    try:
        writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def running_count_writer(key: str, order: Sequence[str], state_path: str, out_path: str):
    """Running count per key across batches: the stored counts of earlier batches plus the count inside this one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        schema = T.StructType([batch.schema[key], T.StructField("n", T.LongType())])
        before = totals_before(batch.sparkSession, state_path, batch_id, schema)
        base = only_keys_of(before, batch, key).groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("_base"))
        inside = with_row_number(with_position(batch, [key, *order]), [key], "_here")
        counted = inside.join(base, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
            "running_count", F.coalesce("_base", F.lit(0)) + F.col("_here")
        )
        put_batch(counted.select(*batch.columns, "running_count"), out_path, batch_id)
        put_totals(batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")), state_path, batch_id, key)

    return write


def poll_range_writer(state_path: str, out_path: str):
    """Max-id polls to id ranges: each batch continues at the largest id of the batches before it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{state_path}/{batch_id - 1}"  # the batch before holds the largest id of all
        before = batch.sparkSession.read.schema("max_id bigint").parquet(path).first()[0] if batch_id else None
        put_batch(poll_ranges(batch, before=before), out_path, batch_id)
        largest = F.greatest(F.max("max_id"), F.lit(before).cast("bigint")).alias("max_id")
        batch.agg(largest).write.mode("overwrite").parquet(f"{state_path}/{batch_id}")

    return write


def keyed_state(
    stream: DataFrame,
    keys: Sequence[str],
    step: Callable,
    output: str | T.StructType,
    state: str | T.StructType,
) -> DataFrame:
    """Extension point for ``step(state_tuple | None, frame) -> (state_tuple, frame)``, called with bounded Arrow frames
    of one key. The work of one key is sequential by contract: where a key may be hot, add a salt to the keys and merge what
    the salts give, or use the writers above."""

    def run(key, frames, group):
        kept = group.get if group.exists else None
        for frame in frames:
            kept, out = step(kept, frame)
            if kept is not None:
                group.update(kept)
            yield out

    return stream.groupBy(*keys).applyInPandasWithState(run, output, state, "append", "NoTimeout")
