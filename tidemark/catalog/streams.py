"""Streaming twins and extension points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import BUDGET, CANDIDATES, DIM, articles, at, candidates, query, questions, r6, scratch, table, words_sql
from tidemark.catalog.history import FILINGS, ENRICHED, filing_feeds, filing_texts, tickers
from tidemark.catalog.sources import POLLS, polls
from tidemark.catalog.texts import buckets_sql, chunks_sql, clean_sql, counts_sql
from tidemark.operators import feeds, ingest, ranking
from tidemark.plans.filings import drain_filings
from tidemark.plans.search import process_queries
from tidemark.sources import news, ranges
from tidemark.sources.sinks import read_collection, upsert
from tidemark.session import filesystem
from tidemark.streaming import jobs

Spark, Rows = SparkSession, DataFrame


def landing(spark: Spark, rows: Rows, batches: int = 4) -> tuple[str, int]:
    """A landing folder that every task of the scan writes some files to, and the number of files that makes ``batches``."""
    path = scratch(spark, "landing")
    rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(batches))).write.partitionBy("part").parquet(path)
    fs, found = filesystem(spark, f"{path}/part=*/*.parquet")
    return f"{path}/part=*", max(1, -(-len(fs.globStatus(found)) // batches))


def landed(spark: Spark, rows: Rows):
    """A stream that reads the rows in about four micro-batches."""
    path, files = landing(spark, rows)
    return jobs.read_landing(spark, path, rows.schema, max_files=files)


def drained(spark: Spark, stream: Rows, write=None) -> Rows:
    """Run the stream to its end and read what it wrote."""
    out = scratch(spark, "out")
    jobs.drain(stream, write or (lambda batch, n: jobs.put_batch(batch, out, n)), scratch(spark, "progress"))
    return spark.read.parquet(out).drop("batch_id")


@query("s8_news_stream", "select event_id, user_id, event_type from events where event_type in ('click', 'view')")
def news_stream(spark: Spark, sf: str) -> Rows:
    rows = table(spark, sf, "events").withColumn("symbols", F.array("event_type"))
    path, files = landing(spark, rows)
    stream = news.read_news(spark, "stream", path, symbols=["click", "view"], fmt="parquet", schema=rows.schema, max_files=files)
    return drained(spark, stream).select("event_id", "user_id", "event_type")


@query("s11_polled_feeds", f"with {FILINGS} select feed_id, entry_no, id, cik, form_type from entries")
def polled_feeds(spark: Spark, sf: str) -> Rows:
    entries = feeds.parse_atom(landed(spark, filing_feeds(spark, sf)), keep=("feed_id",))
    return drained(spark, entries).select("feed_id", "entry_no", "id", "cik", "form_type")


@query("s13_poll_stream", f"with {POLLS} select max_id, unnest(range(low, max_id)) item_id from r where max_id > low")
def poll_stream(spark: Spark, sf: str) -> Rows:
    path, state, out, progress = (scratch(spark, name) for name in ("landing", "state", "out", "progress"))
    asked = polls(spark, sf)
    edges = ["2024-01-01", "2024-01-11", "2024-01-21", "2025-01-01"]
    for low, high in zip(edges, edges[1:]):  # polls land in the order of time
        part = asked.where((F.col("poll_ts") >= at(f"{low} 00:00:00")) & (F.col("poll_ts") < at(f"{high} 00:00:00")))
        part.write.mode("append").parquet(path)
        jobs.drain(jobs.read_landing(spark, path, asked.schema), jobs.poll_range_writer(state, out), progress)  # goes on
    return ranges.unfold_ranges(spark.read.parquet(out), ["max_id"])


@query(
    "m1_ingest_stream",
    f"with {chunks_sql()} select distinct md5(text) chunk_id, len(text)::bigint size from chunks where len({words_sql('text')}) > 0",
)
def ingest_stream(spark: Spark, sf: str) -> Rows:
    path = scratch(spark, "collection")
    order = ["updated_at", "article_id"]
    write = jobs.ingest_writer(lambda batch: ingest.ingest(batch, DIM, order=order, budget=BUDGET)[0], path, order, DIM)
    jobs.drain(landed(spark, articles(spark, sf)), write, scratch(spark, "progress"))
    return read_collection(spark, path).select("chunk_id", F.length("text").cast("bigint").alias("size"))


@query("m2_seen_set", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id) = 1")
def seen_set(spark: Spark, sf: str) -> Rows:
    """The first event of every user, with what it holds; users of earlier batches are known by Spark's state."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    path, out, progress = scratch(spark, "landing"), scratch(spark, "out"), scratch(spark, "progress")
    for low, high in ((0, 0.3), (0.3, 0.6), (0.6, 1.1)):  # events land in the order of their numbers, in three deliveries
        total = events.agg(F.max("event_id")).first()[0] or 0
        events.where((F.col("event_id") >= low * total) & (F.col("event_id") < high * total)).write.mode("append").parquet(path)
        fresh = jobs.first_rows(jobs.read_landing(spark, path, events.schema), ["user_id"], ["event_id"])
        jobs.drain_updates(fresh, lambda batch, n: jobs.put_batch(batch, out, n), progress)
    return spark.read.parquet(out).select("user_id", "event_id", "event_type")


@query("m2_within_watermark", "select distinct user_id, event_type from events")
def within_watermark(spark: Spark, sf: str) -> Rows:
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    stream = jobs.dedupe_within_watermark(landed(spark, rows), ["user_id", "event_type"], "ts", "60 days")
    return drained(spark, stream).select("user_id", "event_type")


@query(
    "m3_running_count_stream",
    """select event_type, row_number() over (partition by event_type order by event_id) running_count
    from (select nullif(event_type, 'view') event_type, event_id from events)""",
)
def running_count_stream(spark: Spark, sf: str) -> Rows:
    state, out = scratch(spark, "state"), scratch(spark, "out")
    kind = F.nullif("event_type", F.lit("view"))  # a null key counts like any other
    stream = landed(spark, table(spark, sf, "events").select(kind.alias("event_type"), "event_id"))
    jobs.drain(stream, jobs.running_count_writer("event_type", ["event_id"], state, out), scratch(spark, "progress"))
    return spark.read.parquet(out).select("event_type", "running_count")


@query("m4_replayed_batches", "select md5(text) chunk_id, count(*) copies from documents group by 1")
def replayed_batches(spark: Spark, sf: str) -> Rows:
    """Every batch is delivered twice; a copy that was counted twice would show in the sums."""
    path = scratch(spark, "collection")
    docs = table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id")

    def write(batch: Rows, batch_id: int) -> None:
        counts = batch.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
        counts = counts.withColumn("chunk_id", F.concat("digest", F.lit(f"-{batch_id}")))
        for _ in range(2):
            upsert(counts, path, batch_id, order=["copies"], writer="stream")

    jobs.drain(landed(spark, docs), write, scratch(spark, "progress"))
    stored = read_collection(spark, path)
    return stored.groupBy(F.col("digest").alias("chunk_id")).agg(F.sum("copies").alias("copies"))


@query("m5_timed_batches", "select event_id, value from events")
def timed_batches(spark: Spark, sf: str) -> Rows:
    out = scratch(spark, "out")
    stream = landed(spark, table(spark, sf, "events"))
    running = jobs.start(stream, lambda batch, n: jobs.put_batch(batch, out, n), scratch(spark, "progress"), jobs.NEWS_BATCH)
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(out).select("event_id", "value")


@query("g8_filings_stream", f"with {FILINGS}{ENRICHED} select ticker as key, id, form_type from e where ticker is not null")
def filings_stream(spark: Spark, sf: str) -> Rows:
    out = scratch(spark, "out")
    feed = landed(spark, filing_feeds(spark, sf))
    drain_filings(feed, tickers(spark, sf), filing_texts(spark, sf), out, scratch(spark, "progress"), order="feed_id")
    back = spark.read.parquet(out)
    parsed = F.from_json("value", "id string, form_type string")
    return back.select("key", parsed.alias("v")).select("key", "v.id", "v.form_type")


# --- P: extension points ----------------------------------------------------------------------------------------------


@query("p1_custom_steps", "select event_type, round(sum(value * 2), 4) total from events where value > 10 group by 1")
def custom_steps(spark: Spark, sf: str) -> Rows:
    def doubled(df: Rows) -> Rows:
        return df.withColumn("value", F.col("value") * 2)

    def large(df: Rows, least: float) -> Rows:
        return df.where(F.col("value") > least)

    rows = table(spark, sf, "events").transform(large, 10).transform(doubled)
    return rows.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@query("p2_keyed_state", "select event_type, count(*) n, sum(event_id)::bigint ids from events group by 1")
def keyed_state(spark: Spark, sf: str) -> Rows:
    def step(state, frame):
        n, ids = state or (0, 0)
        n, ids = n + len(frame), ids + int(frame["event_id"].sum())
        return (n, ids), pd.DataFrame({"event_type": [frame["event_type"].iloc[0]], "salt": [frame["salt"].iloc[0]], "n": [n], "ids": [ids]})

    salt = F.pmod(F.xxhash64("event_id"), F.lit(16)).cast("int").alias("salt")  # no task holds all rows of a type
    stream = landed(spark, table(spark, sf, "events").select("event_type", salt, "event_id"))
    counted = jobs.keyed_state(stream, ["event_type", "salt"], step, "event_type string, salt int, n bigint, ids bigint", "n bigint, ids bigint")
    ends = drained(spark, counted).groupBy("event_type", "salt").agg(F.max("n").alias("n"), F.max("ids").alias("ids"))
    return ends.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def _model():
    """A stand-in for an embedding model: loaded once per worker, called with Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib
        import re

        import numpy as np

        known: dict[str, int] = {}
        for texts in batches:  # the words of a whole batch go into one matrix
            words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
            for word in set().union(*words) - known.keys():
                known[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64
            slots = np.array([known[w] for part in words for w in part], np.int64)
            counts = np.zeros((len(texts), 64))
            np.add.at(counts, (np.repeat(np.arange(len(texts)), [len(part) for part in words]), slots), 1)
            length = np.sqrt((counts * counts).sum(axis=1))
            vectors = counts / np.where(length == 0, 1, length)[:, None]
            yield pd.Series([v.tolist() if n else None for v, n in zip(vectors, length, strict=True)])

    return embed


@query(
    "p3_embedding_model",
    f"""with v as (select item_id query_id, {counts_sql('b')} v from (select item_id, {buckets_sql('t')} b from (select item_id, {clean_sql('text')} t from benchmark)))
    select query_id, round(list_max(v) / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) strongest from v""",
)
def embedding_model(spark: Spark, sf: str) -> Rows:
    rows = process_queries(questions(spark, sf), embed=_model())
    return rows.select("query_id", r6(F.array_max("embedding")).alias("strongest"))


@query(
    "p4_pair_scorer",
    f"""with {CANDIDATES}, p as (select query_id, chunk_id, length(query) / (length(query) + length(text)) s from cand)
    select query_id, chunk_id, round(exp(s - mx) / sum(exp(s - mx)) over (partition by query_id), 6) rerank_score
    from (select *, max(s) over (partition by query_id) mx from p)""",
)
def pair_scorer(spark: Spark, sf: str) -> Rows:
    @F.pandas_udf("double")
    def scorer(query_: pd.Series, text: pd.Series) -> pd.Series:
        asked, told = query_.str.len(), text.str.len()
        return asked / (asked + told)

    rows = ranking.rerank(candidates(spark, sf), scorer)
    return rows.select("query_id", "chunk_id", r6("rerank_score").alias("rerank_score"))


@query(
    "p5_range_source",
    "select event_id, event_type from events where ts >= timestamp '2024-01-03' and ts <= timestamp '2024-01-25 12:00:00'",
)
def range_scan(spark: Spark, sf: str) -> Rows:
    """Spark's own scan: the bounds are pushed down, splits follow size and not time, and any storage works."""
    rows = news.time_range(table(spark, sf, "events"), "ts", at("2024-01-03 00:00:00"), at("2024-01-25 12:00:00"))
    return rows.select("event_id", "event_type")
