"""Contexts, prompts, source records and score tables from ranked hits.

Ranked hits hold at most ``limit`` rows per query, so the lists built here are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.records import or_na
from tidemark.functions.text import shorten

SCORE_TYPES = {  # shown name -> column
    "Weighted": "weighted_avg_score",
    "Harmonic": "harmonic_mean_score",
    "Geometric": "geometric_mean_score",
    "Decay": "decay_score",
    "Similarity": "score",
    "Cross-Encoder": "rerank_score",
}
ANSWER_PROMPT = (
    "Answer the question from the context below, briefly and objectively. Say so when the context is not enough.\n"
    "Context:\n{context}\n\nQuestion: {question}\n"
)
ANALYSIS_PROMPT = (
    "Analyse the news below: developments, implications, likely outcomes, each with its evidence.\n"
    "Context:\n{context}\n\nQuestion: {question}\n"
)


def _line(label: str, value: Column) -> Column:
    """``label: value`` and a line end, or nothing for a missing value."""
    return F.when(value.isNull() | (value == ""), F.lit("")).otherwise(F.concat(F.lit(f"{label}: "), value, F.lit("\n")))


def source_part(number: Column, headline: Column, created_at: Column, text: Column, score: Column) -> Column:
    return F.concat(
        F.lit("Source "),
        number.cast("string"),
        F.lit(":\n"),
        _line("Headline", headline),
        _line("Date", F.date_format(created_at, "yyyy-MM-dd HH:mm:ss")),
        F.lit("Content: "),
        text,
        F.lit("\n"),
        _line("Relevance Score", F.format_string("%.3f", score)),
    )


def join_parts(ranked: DataFrame, part: Column, query: str = "query_id", rank: str = "rank", separator: str = "\n\n"):
    """One text per query from its parts in rank order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("p"))))
    return ranked.groupBy(query).agg(F.array_join(F.transform(listed, lambda x: x["p"]), separator).alias("context"))


def format_context(ranked: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    part = source_part(
        F.col(rank), F.col("headline"), F.col("created_at"), F.col("text"), F.col("rerank_score")
    )
    return join_parts(ranked, part, query, rank)


def plain_context(ranked: DataFrame, query: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """``Content i:`` blocks, numbered from 0."""
    part = F.concat(F.lit("Content "), (F.col(rank) - 1).cast("string"), F.lit(":\n"), F.col(text))
    return join_parts(ranked, part, query, rank)


def prompts(contexts: DataFrame, question: str = "query", analysis_mode: bool = False, template: str | None = None):
    """Fill the two slots of the template for every query row."""
    template = template or (ANALYSIS_PROMPT if analysis_mode else ANSWER_PROMPT)
    before, rest = template.split("{context}", 1)
    middle, after = rest.split("{question}", 1)
    return contexts.withColumn(
        "prompt", F.concat(F.lit(before), F.col("context"), F.lit(middle), F.col(question), F.lit(after))
    )


def source_records(ranked: DataFrame, query: str = "query_id", rank: str = "rank", packed: bool = True) -> DataFrame:
    """The sources of each answer: one row each, or packed to a list per query."""
    fields = [
        or_na(F.col("headline")).alias("headline"),
        or_na(F.col("url")).alias("url"),
        or_na(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        F.coalesce(F.col("symbols"), F.array().cast("array<string>")).alias("symbols"),
        or_na(F.col("author")).alias("author"),
        F.col("text").alias("content"),
        "rerank_score",
        F.col("weighted_avg_score").alias("weighted_score"),
        F.col("harmonic_mean_score").alias("harmonic_score"),
        F.col("geometric_mean_score").alias("geometric_score"),
        "decay_score",
        F.col("score").alias("original_score"),
        "updated_at",
        "article_id",
    ]
    if not packed:
        return ranked.select(query, rank, *fields)
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.struct(*fields).alias("s"))))
    return ranked.groupBy(query).agg(F.transform(listed, lambda x: x["s"]).alias("sources"))


def score_table_long(ranked: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """One row per source and score type."""
    source = F.concat(F.lit("Source "), F.col(rank).cast("string"), F.lit(": "), shorten(F.col("headline")))
    wide = ranked.select(query, source.alias("source"), *[F.col(c).alias(n) for n, c in SCORE_TYPES.items()])
    return wide.unpivot([query, "source"], list(SCORE_TYPES), "score_type", "score")


def score_table_wide(
    long: DataFrame,
    keys: tuple[str, ...] = ("query_id", "source"),
    types: tuple[str, ...] = tuple(SCORE_TYPES),
    digits: int = 3,
) -> DataFrame:
    """One column per score type, rounded. The types are given, so the pivot needs no pass to find them."""
    table = long.groupBy(*keys).pivot("score_type", list(types)).agg(F.first("score"))
    return table.select(*keys, *[F.round(F.col(f"`{n}`"), digits).alias(n) for n in types])
