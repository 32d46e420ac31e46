"""Re-ranking and score fusion over the candidates of each query.

A candidate set is bounded by the over-fetch (``limit * 10`` per query vector), so windows per query stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.freshness import Freshness, age_hours
from tidemark.functions.fusion import Fusion, in_unit_range
from tidemark.functions.text import let, words
from tidemark.operators.knn import top_k

METHODS = {
    "Weighted Average": "weighted_avg_score",
    "Harmonic Mean": "harmonic_mean_score",
    "Geometric Mean": "geometric_mean_score",
}


def softmax_scores(df: DataFrame, score: str, group: str, name: str) -> DataFrame:
    """Softmax per group, shifted by the largest score."""
    w = Window.partitionBy(group)
    return (
        df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
        .withColumn(name, F.col("_e") / F.sum("_e").over(w))
        .drop("_e")
    )


def min_max(score: Column, group: str) -> Column:
    """Scaled to [0, 1] per group; equal scores give 0."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).when(score.isNotNull(), F.lit(0.0))


def rank_fraction(score: Column, group: str) -> Column:
    """Position of the first equal score in descending order, over the number of scores."""
    ordered = Window.partitionBy(group).orderBy(score.desc())
    return (F.rank().over(ordered) - 1) / F.count(F.lit(1)).over(Window.partitionBy(group))


def word_share(query: Column, text: Column) -> Column:
    """Default pair scorer: the share of the query's distinct words that the text holds."""
    return let(
        F.array_distinct(words(query)),
        lambda asked: F.coalesce(
            F.try_divide(F.size(F.array_intersect(asked, words(text))), F.size(asked)), F.lit(0.0)
        ),
    )


def rerank(
    candidates: DataFrame,
    scorer: Callable[[Column, Column], Column] = word_share,
    group: str = "query_id",
    query: str = "query",
    text: str = "text",
) -> DataFrame:
    """Add ``rerank_score``: the pair scores of a query's candidates as probabilities."""
    scored = candidates.withColumn("_pair", scorer(F.col(query), F.col(text)))
    return softmax_scores(scored, "_pair", group, "rerank_score").drop("_pair")


def add_decay(
    candidates: DataFrame, as_of: Column, model: Freshness = Freshness(), updated_at: str = "updated_at"
) -> DataFrame:
    return candidates.withColumn("decay_score", model.confidence(age_hours(F.col(updated_at), as_of)))


def add_scores(candidates: DataFrame, fusion: Fusion = Fusion(), range_mode: str = "null") -> DataFrame:
    """Add the three combined scores; a missing signal, or one out of range, leaves them null."""
    s, c, t = (in_unit_range(F.col(x), range_mode) for x in ("score", "rerank_score", "decay_score"))
    return candidates.withColumns(
        {
            "weighted_avg_score": fusion.weighted_average(s, c, t),
            "harmonic_mean_score": fusion.harmonic_mean(s, c, t),
            "geometric_mean_score": fusion.geometric_mean(s, c, t),
        }
    )


def rank_fusion(
    df: DataFrame,
    group: str = "query_id",
    scores: tuple[str, str, str] = ("score", "rerank_score", "decay_score"),
    fusion: Fusion = Fusion(),
    name: str = "fusion_score",
) -> DataFrame:
    """Weighted rank fractions scaled per group; 0 is best."""
    weights = (fusion.similarity, fusion.cross_encoder, fusion.time_decay)
    fractions = {f"_f{i}": rank_fraction(F.col(s), group) for i, s in enumerate(scores)}
    mixed = df.withColumns(fractions).withColumn(
        "_mix", sum((F.lit(w) * F.col(f"_f{i}") for i, w in enumerate(weights)), F.lit(0.0))
    )
    return mixed.withColumn(name, min_max(F.round("_mix", 12), group)).drop("_mix", *fractions)


def rank_articles(
    candidates: DataFrame,
    limit: int,
    scoring_method: str = "Weighted Average",
    scorer: Callable[[Column, Column], Column] | None = word_share,
    use_time_decay: bool = False,
    as_of: Column | None = None,
    group: str = "query_id",
    id_col: str = "chunk_id",
    fusion: Fusion = Fusion(),
    range_mode: str = "null",
) -> DataFrame:
    """Best ``limit`` candidates per query by the chosen score.

    Where a combined score is null the order falls back to the re-rank score, then to the similarity.
    """
    if scoring_method not in METHODS:
        raise ValueError(f"unknown scoring method: {scoring_method}")
    if use_time_decay and as_of is None:
        raise ValueError("time decay needs as_of")
    nothing = F.lit(None).cast("double")
    out = rerank(candidates, scorer, group) if scorer else candidates.withColumn("rerank_score", nothing)
    out = add_decay(out, as_of) if use_time_decay else out.withColumn("decay_score", nothing)
    out = add_scores(out, fusion, range_mode)
    # rounded, so that the order of equal scores is decided by the id and not by the last bit
    order = [F.round(c, 12).desc_nulls_last() for c in (METHODS[scoring_method], "rerank_score", "score")]
    return top_k(out, [group], [*order, F.col(id_col)], limit)
