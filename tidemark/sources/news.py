"""News scans: one entry point for a message feed, a time-bounded batch and a landing directory."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ingest import parse_messages, validate
from tidemark.schemas import NEWS

MODES = ("mock", "batch", "stream")
WILDCARD = "*"


def read_news(
    spark: SparkSession,
    mode: str,
    path: str,
    start: Column | None = None,
    end: Column | None = None,
    symbols: Sequence[str] = (WILDCARD,),
    fmt: str = "json",
    schema: T.StructType = NEWS,
    ts: str = "created_at",
    max_files: int = 1000,
) -> DataFrame:
    """Articles from ``path``. ``mock``: one JSON payload per line, each a list of messages or one message (``read_mock``
    has the rejected ones); ``batch``: article files within ``[start, end]``; ``stream``: the same files as they land."""
    if mode == "mock":
        accepted, _ = read_mock(spark, path)
        rows = accepted.select(*[f.name for f in NEWS])
        return subscribe(time_range(rows, ts, start, end), symbols)
    if mode == "batch":
        if start is None or end is None:
            raise ValueError("a batch scan needs both bounds")
        table = spark.read.schema(schema).format(fmt).load(path)
        return subscribe(time_range(table, ts, start, end), symbols)
    if mode == "stream":
        landing = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)
        return subscribe(landing, symbols)
    raise ValueError(f"unknown mode: {mode}")


def read_mock(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid messages, rejected ones) of payload lines."""
    lines = spark.read.text(path).withColumn("batch_id", F.monotonically_increasing_id())
    return validate(parse_messages(lines, "value"))


def mock_payloads(batches: DataFrame, messages: str = "messages") -> DataFrame:
    """Lists of messages to one row per message."""
    return batches.select("batch_id", F.posexplode(messages).alias("position", "m")).select("batch_id", "position", "m.*")


def time_range(df: DataFrame, ts: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows within the given bounds, both inclusive and both optional; plain comparisons, so they reach the scan."""
    return where_all(df, [F.col(ts) >= start if start is not None else None, F.col(ts) <= end if end is not None else None])


def time_scan(df: DataFrame, ts: str, row_id: str, start: Column, end: Column) -> DataFrame:
    """A bounded scan in ascending order."""
    return time_range(df, ts, start, end).orderBy(ts, row_id)


def last_days(df: DataFrame, ts: str, as_of: Column, n: int = 1) -> DataFrame:
    return time_range(df, ts, as_of - F.make_dt_interval(F.lit(n)), as_of)


def where_all(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """AND of the conditions that are given; none leaves the rows as they are."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def match_any(values: Column, wanted: Sequence[str] | None) -> Column | None:
    """Condition on a list column; no wanted values, no condition."""
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])) if wanted else None


def subscribe(df: DataFrame, symbols: Sequence[str], column: str = "symbols") -> DataFrame:
    """Rows of the subscribed symbols; the wildcard keeps all."""
    return df if WILDCARD in symbols else where_all(df, [match_any(F.col(column), list(symbols))])


def scroll(df: DataFrame, condition: Column, row_id: str, n: int) -> DataFrame:
    """First page of the matching rows by id."""
    return df.where(condition).orderBy(row_id).limit(n)


PRESETS = {"Past day": 1, "Past week": 7, "Past month": 30}


def date_preset(preset: Column, as_of: Column, custom_from: Column | None = None, custom_to: Column | None = None):
    """(date_from, date_to) of a named preset; ``All time`` gives nulls."""
    nothing = F.lit(None).cast("timestamp_ntz")
    date_from, date_to = nothing, nothing
    for name, days in PRESETS.items():
        date_from = F.when(preset == name, as_of - F.make_dt_interval(F.lit(days))).otherwise(date_from)
        date_to = F.when(preset == name, as_of).otherwise(date_to)
    if custom_from is not None:
        date_from = F.when(preset == "Custom", custom_from).otherwise(date_from)
    if custom_to is not None:
        date_to = F.when(preset == "Custom", custom_to).otherwise(date_to)
    return date_from, date_to


def typed_points(points: DataFrame) -> DataFrame:
    """Stored points as result rows: string ids, ``score`` null where the point carries none, empty score slots."""
    score = F.col("score").cast("double") if "score" in points.columns else F.lit(None).cast("double")
    slots = ("rerank", "decay", "geometric_mean", "harmonic_mean", "weighted_avg", "fusion")
    return points.withColumns(
        {
            "article_id": F.col("article_id").cast("string"),
            "chunk_id": F.col("chunk_id").cast("string"),
            "score": score,
            **{f"{s}_score": F.lit(None).cast("double") for s in slots},
        }
    ).withColumnRenamed("embedding", "text_embedding")
