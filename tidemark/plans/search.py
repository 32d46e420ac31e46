"""Search plans: query processing, first stage, union of hits, ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fusion import Fusion
from tidemark.functions.text import clean_all
from tidemark.functions.vectors import hash_embedding
from tidemark.operators.ingest import chunk_text
from tidemark.operators.knn import attach_payload, nearest, query_vectors, union_hits
from tidemark.operators.ranking import rank_articles, word_share
from tidemark.sources.news import match_any, time_range, where_all
from tidemark.sources.sinks import DAY

OVER_FETCH = 10


def process_queries(
    queries: DataFrame,
    embed: Callable[[Column], Column] | None = None,
    dim: int = 64,
    query: str = "query",
    **chunking,
) -> DataFrame:
    """Clean, chunk and embed every query text: ``query_id, part_no, chunk, embedding``."""
    embed = embed or (lambda t: hash_embedding(t, dim))
    parts = queries.select("query_id", F.posexplode(chunk_text(clean_all(F.col(query)), **chunking)).alias("part_no", "chunk"))
    return parts.withColumn("embedding", embed(F.col("chunk")))


def search(
    collection: DataFrame,
    queries: DataFrame,
    limit: int = 3,
    use_time_decay: bool = False,
    scoring_method: str = "Weighted Average",
    as_of: Column | None = None,
    scorer: Callable[[Column, Column], Column] | None = word_share,
    embed: Callable[[Column], Column] | None = None,
    dim: int = 64,
    strict_union: bool = False,
    floor: float | None = None,
    fusion: Fusion = Fusion(),
    **chunking,
) -> DataFrame:
    """Best ``limit`` chunks for every row of ``queries(query_id, query)``.

    The pair scorer sees the raw query, retrieval the cleaned one. The top-k carries ids and scores; texts and metadata
    are joined to the few hits that are left. Hits below ``floor`` are dropped before ranking.
    """
    fetch = limit * OVER_FETCH if scorer else limit
    vectors = query_vectors(process_queries(queries, embed, dim, **chunking), ("query_id", "part_no"))
    hits = union_hits(nearest(collection, vectors, fetch), strict=strict_union)
    if floor is not None:
        hits = hits.where(F.col("score") >= floor)
    # every hit is a row of the collection, so an inner join keeps them all
    candidates = attach_payload(hits, collection.drop("embedding"), how="inner", max_hits=vectors.max_hits(fetch))
    asked = candidates.join(queries.select("query_id", "query"), "query_id")
    return rank_articles(asked, limit, scoring_method, scorer, use_time_decay, as_of, fusion=fusion)


def search_by_filters(
    collection: DataFrame,
    queries: DataFrame,
    symbols: Sequence[str] | None = None,
    date_from: Column | None = None,
    date_to: Column | None = None,
    conditions: Sequence[Column | None] = (),
    limit: int = 3,
    min_score: float | None = None,
    prefilter: bool = False,
    **options,
) -> DataFrame:
    """Search over the chunks that meet all conditions. ``min_score`` cuts the result after the limit; with
    ``prefilter`` the limit counts only hits that reach it. Of a collection that is stored by day only the days between
    the dates are read."""
    kept = time_range(collection, "created_at", date_from, date_to)
    if DAY in collection.columns:
        kept = time_range(kept, DAY, *[None if d is None else F.to_date(d) for d in (date_from, date_to)]).drop(DAY)
    kept = where_all(kept, [match_any(F.col("symbols"), symbols), *conditions])
    if prefilter:
        return search(kept, queries, limit, floor=min_score, **options)
    found = search(kept, queries, limit, **options)
    return found if min_score is None else found.where(F.col("score") >= min_score)
