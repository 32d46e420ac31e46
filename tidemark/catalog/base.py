"""Registry of the queries that run on the test tables, each with its SQL twin where one can be written."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize, shared_dir, widen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the engine works in one time zone."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path for what a query writes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- query vectors and candidates on the embeddings table -------------------------------------------------------------

AS_OF = "2024-01-02 00:00:00"  # inside the data, so that ages fall on both sides of the decay range


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    means = parts.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"])
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(vector.alias("embedding"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def payload(spark: SparkSession, sf: str) -> DataFrame:
    """Text and, where there is one, time of every document: the event of the same number."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
    times = table(spark, sf, "events").select(
        F.col("event_id").alias("chunk_id"), F.col("ts").alias("updated_at"), "event_type"
    )
    return docs.join(times, "chunk_id", "left")


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The query vector of every question: the stored vector of the same number."""
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return questions(spark, sf).join(known, "query_id")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CENTROIDS = """cent as (
  select label::bigint query_id, list(v order by p) embedding from (
    select label, p, avg(v) v from (
      select label, unnest(embedding)::double v, generate_subscripts(embedding, 1) p from embeddings)
    group by label, p)
  group by label)"""
PAIRS = CENTROIDS + """, pairs as (
  select c.query_id, e.vec_id chunk_id, round(list_cosine_similarity(e.embedding::double[], c.embedding), 9) score
  from cent c, embeddings e)"""


def hits_sql(k: int) -> str:
    return PAIRS + f""", hits as (
  select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from pairs)
  where rank <= {k})"""


PAYLOAD = """payload as (
  select d.doc_id chunk_id, d.text, d.lang, d.source, e.ts updated_at, e.event_type
  from documents d left join events e on e.event_id = d.doc_id)"""
CONFIDENCE = "case when age <= 4 then 1.0 when age is not null then greatest(exp(-0.15 * (age - 4)), 0.1) end"


def age_sql(ts: str, as_of: str = AS_OF) -> str:
    return f"((epoch_us(timestamp '{as_of}') - epoch_us({ts})) / 3.6e9)"


def words_sql(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def share_sql(asked: str, text: str) -> str:
    q = f"list_distinct({words_sql(asked)})"
    return f"coalesce(len(list_intersect({q}, {words_sql(text)})) / nullif(len({q}), 0), 0.0)"


CANDIDATES = (
    PAYLOAD
    + f""", asked as (
  select b.item_id query_id, b.text query, e.embedding::double[] v from benchmark b join embeddings e on e.vec_id = b.item_id),
pairs as (
  select a.query_id, a.query, e.vec_id chunk_id, round(list_cosine_similarity(e.embedding::double[], a.v), 9) score
  from asked a, embeddings e),
hits as (select * from pairs qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 30),
cand0 as (
  select h.query_id, h.chunk_id, h.score, p.text, h.query, p.updated_at,
    {share_sql('h.query', 'p.text')} pair, {age_sql('p.updated_at')} age
  from hits h left join payload p using (chunk_id)),
cand as (
  select *, exp(pair - max(pair) over (partition by query_id)) / sum(exp(pair - mx)) over (partition by query_id) rerank_score,
    {CONFIDENCE} decay_score
  from (select *, max(pair) over (partition by query_id) mx from cand0))"""
)


def candidates(spark: SparkSession, sf: str, k: int = 30) -> DataFrame:
    """Hits of every question, with text and time where they have any."""
    from tidemark.operators.knn import attach_payload, nearest, query_vectors

    asked = query_vectors(question_vectors(spark, sf))
    found = nearest(vectors(spark, sf), asked, k).drop("rank")
    rows = attach_payload(found, payload(spark, sf), max_hits=asked.max_hits(k))
    return rows.join(questions(spark, sf), "query_id")


def scored_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the three signals."""
    from tidemark.operators.ranking import add_decay, rerank

    return add_decay(rerank(candidates(spark, sf)), at(AS_OF))


# --- text collection --------------------------------------------------------------------------------------------------

DIM = 64
BUDGET = 384


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as news articles; times come from the event of the same number."""
    docs = widen(table(spark, sf, "documents"))
    times = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    return docs.join(times, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Report "), "source").alias("headline"),
        F.col("lang").alias("summary"),
        F.concat(F.lit("desk "), "lang").alias("author"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.concat(F.lit("https://news.example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
        F.array("source").alias("symbols"),
        F.col("source"),
    )


def collection(spark: SparkSession, sf: str) -> DataFrame:
    """Every document chunked, embedded and stored once; equal chunks keep the newest article."""
    from tidemark.operators.ingest import ingest

    points, _ = ingest(articles(spark, sf), DIM, order=["updated_at", "article_id"], budget=BUDGET)
    return materialize(points)
