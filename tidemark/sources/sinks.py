"""Where rows go: chunk collections, JSON files, counters.

A collection is a folder of Parquet folders, one per batch of a writer, and a log with one small file per committed batch. A
batch is seen by readers once it is in the log; its place in the log, which a replay keeps, says which write of an id is
the last. So any number of writers share a collection, and writing costs what the batch costs, whatever it holds.
``compact`` folds the batches when they have become many. What was folded is noted per writer, and a batch that is delivered
again after that changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import has_dimension
from tidemark.operators.versions import latest_by
from tidemark.session import filesystem, materialize

LOG = "_commits"  # a folder that Spark's readers of the collection pass over
SNAPSHOT = "_snapshot"  # writer of a compacted collection
WRITER = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]*")
DAY = "created_day"  # partition of collections that are stored by day
COMMIT = "writer string, batch_id long, place long, folded boolean"


@dataclass(frozen=True)
class Commits:
    """What the log holds: the place of every batch, and per writer the last batch that compaction has folded."""

    places: dict[tuple[str, int], int]
    folded: dict[str, int]

    def next_place(self) -> int:
        return max(self.places.values(), default=0) + 1


def checked(points: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Stop the job on a vector of another size."""
    problem = F.raise_error(F.lit(f"vector size is not {dim}")).cast(points.schema[vector].dataType)
    return points.withColumn(vector, F.when(has_dimension(F.col(vector), dim), F.col(vector)).otherwise(problem))


def _part(writer: str, batch_id: int) -> str:
    return f"w.{writer}.{batch_id}"  # never read as a number or a date


def commits(spark: SparkSession, path: str) -> Commits:
    """The log of a collection, one row per batch since the last compaction; empty for a new one."""
    fs, log = filesystem(spark, f"{path}/{LOG}")
    rows = spark.read.schema(COMMIT).json(f"{path}/{LOG}").collect() if fs.exists(log) else []
    places = {(r["writer"], r["batch_id"]): r["place"] for r in rows if not r["folded"]}
    return Commits(places, {r["writer"]: r["batch_id"] for r in rows if r["folded"]})


def _write(rows: DataFrame, folder: str) -> None:
    out = rows.write.mode("overwrite")
    (out.partitionBy(DAY) if DAY in rows.columns else out).parquet(folder)


def _note(spark: SparkSession, path: str, name: str, lines: Sequence[dict], replace: bool = False) -> None:
    """One file of the log, as a whole; without ``replace`` a file that is there stays."""
    fs, file = filesystem(spark, f"{path}/{LOG}/{name}.json")
    if fs.exists(file) and not replace:
        return
    out = fs.create(file, replace)
    out.write(bytearray("".join(json.dumps(line) + "\n" for line in lines).encode()))
    out.close()


def upsert(
    points: DataFrame,
    path: str,
    batch_id: int,
    order: Sequence[str],
    key: str = "chunk_id",
    dim: int | None = None,
    writer: str = "main",
    by_day: str | None = None,
) -> None:
    """Store one batch of a writer; the folder is created on first use. Within the batch the last row per ``key`` in
    ``order`` stays; the order must tell rows of a key apart, so that a replayed batch stores the same rows. ``by_day`` names
    a time column by whose days the batch is partitioned, in ``created_day``; all batches of a collection or none.

    Each stream into a collection is a ``writer`` of its own, whose batches come in ascending order; several may write at a
    time. Of batches that meet the same place in the log, the one of the greater writer name counts as the later.
    """
    if batch_id < 0:
        raise ValueError("batch numbers start at 0")
    if not WRITER.fullmatch(writer):
        raise ValueError(f"not a name for a writer: {writer!r}")
    spark = points.sparkSession
    before = commits(spark, path)
    if batch_id <= before.folded.get(writer, -1):
        return  # delivered again after compaction has folded it
    rows = (checked(points, dim) if dim is not None else points).drop("part")
    rows = latest_by(rows, [key], order)
    _write(rows if by_day is None else rows.withColumn(DAY, F.to_date(by_day)), f"{path}/part={_part(writer, batch_id)}")
    place = before.places.get((writer, batch_id), before.next_place())
    _note(spark, path, f"{writer}.{batch_id}", [{"writer": writer, "batch_id": batch_id, "place": place, "folded": False}])


def read_collection(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """The last write of every id. A collection of one batch, as compaction leaves it, is read as it is.

    Only ids and places are aggregated; an id that was written more than once drops its earlier rows, all others pass as
    they are. Batches that are not in the log are not read.
    """
    known = commits(spark, path)
    if not known.places:
        raise FileNotFoundError(f"no batch has been committed to {path}")
    folders = [f"{path}/part={_part(*batch)}" for batch in known.places]
    if len(folders) == 1:
        return spark.read.parquet(folders[0])
    order = sorted(known.places, key=lambda batch: (known.places[batch], batch))
    ranks = spark.createDataFrame([(_part(*batch), n) for n, batch in enumerate(order)], "part string, _place int")
    rows = spark.read.option("basePath", path).parquet(*folders).join(F.broadcast(ranks), "part").drop("part")
    places = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_place").alias("_last"), F.count(F.lit(1)).alias("_n"))
    again = materialize(places.where("_n > 1").select("_key", "_last"))
    joined = rows.join(again, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.where("_last is null or _place = _last").drop("_place", "_key", "_last")


def compact(spark: SparkSession, path: str, target: str, key: str = "chunk_id") -> None:
    """The collection as one batch at ``target``, which replaces ``path`` for readers and writers once it is complete.
    Writers go on at ``target`` where they were."""
    known = commits(spark, path)
    _write(read_collection(spark, path, key), f"{target}/part={_part(SNAPSHOT, 0)}")
    folded = dict(known.folded)
    for writer, batch_id in known.places:
        if writer != SNAPSHOT:
            folded[writer] = max(batch_id, folded.get(writer, -1))
    _note(spark, target, "folded", [{"writer": w, "batch_id": b, "place": 0, "folded": True} for w, b in sorted(folded.items())], True)
    _note(spark, target, "snapshot", [{"writer": SNAPSHOT, "batch_id": 0, "place": 0, "folded": False}], True)


def merge_latest(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """What a collection holds after an upsert, as a plain query."""
    return latest_by(target.unionByName(batch), [key], [order])


def dump_json(df: DataFrame, path: str) -> None:
    """The batch as JSON records, replacing the last dump."""
    df.write.mode("overwrite").json(path)


def keyed_json(df: DataFrame, key: Column) -> DataFrame:
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_keyed_json(df: DataFrame, key: Column, path: str, mode: str = "append") -> None:
    """JSON lines in one folder per key. Rows stay in the tasks that they are in, so a hot key is written by all of them."""
    keyed_json(df, key).write.mode(mode).partitionBy("key").text(path)


def tap(df: DataFrame, name: str, *metrics: Column):
    """(the same rows, an observation that holds the metrics once an action has run)."""
    seen = Observation(name)
    return df.observe(seen, *(metrics or [F.count(F.lit(1)).alias("rows")])), seen
