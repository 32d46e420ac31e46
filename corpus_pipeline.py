"""Corpus pipeline: toxic documents go, bad ones go, one of each group of near copies stays, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash, packing, quality, toxicity
from tidemark.llm.common import scratch, table
from tidemark.llm.queries import BPE_JSON, PACK_END, SEQUENCE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5. It learns from the labels outside the held-out fold. Null and empty
    texts score as texts without words; repeated rows share their fate. With too few labels to tell texts apart all stay."""
    weights = toxicity.fit_labels(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(weights, "text", unknown=0.0) < 0.5)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and every certified cutoff of their language. Null texts fail the base rules."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate class; null ids stay, and of an id with several texts only
    those go that are copies of another document."""
    return minhash.keep_one(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of a fixed number of tokens."""
    return packing.pack(docs, public_tokenizers.path(BPE_JSON), PACK_END, SEQUENCE, encode_special_tokens=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_bad),
    ("near_dedup", drop_near_copies),
    ("packing", pack_documents),
]
ORACLE_SQL = None  # tokens, hashed features and sketches are beyond SQL; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
