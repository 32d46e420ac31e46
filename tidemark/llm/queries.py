"""Registered queries of this package: each applies one operator, as it would run in production, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    ann,
    bitplane,
    bpe,
    langid,
    minhash,
    packing,
    quality,
    quality_net,
    resampling,
    sharding,
    toxicity,
    warc,
    whitening,
)
from tidemark.llm.common import held_out, scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}  # none of them can be written in SQL; tests/llm holds them against plain versions

BPE_JSON = "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PACK_END, FILE_END = 1, 2
SEQUENCE = 2048
SHARDS = 24
CRAWL_DATE = "2024-01-01T00:00:00Z"


def query(name: str):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = run
        return run

    return add


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return packing.pack(docs, public_tokenizers.path(BPE_JSON), PACK_END, SEQUENCE, encode_special_tokens=False)


@query("op2_near_duplicates")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.classes(table(spark, sf, "documents"))


@query("op3_sharding")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"), SHARDS)


@query("op4_quality_rules")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    ruled = quality.rule(docs, table(spark, sf, "labels"), columns=["doc_id", "lang"])
    stats = [F.col("_stats")[s].alias(s) for s in quality.STATS if s != "n_lines"]
    return ruled.select("doc_id", *stats, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


@query("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.filter(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), langid.predict(model, "text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op6_bit_planes")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "planes")
    docs = table(spark, sf, "documents")
    bitplane.write_ids(docs, path, public_tokenizers.path(BPE_JSON), FILE_END, encode_special_tokens=False)
    return bitplane.read_ids(spark, path)


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


@query("op8_warc_derivatives")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_records(warc.responses_of_pages(table(spark, sf, "pages"), CRAWL_DATE), path)
    found = warc.derive(warc.read_records(spark, path))
    page = F.regexp_extract("headers", r"(?m)^WARC-Page-ID: (-?\d+)$", 1)
    return found.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        *[c for c in warc.FIELDS if c != "block"],
        F.col("block").cast("string").alias("block"),
    )


@query("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    weights = toxicity.fit_labels(docs, table(spark, sf, "labels"))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity.score(weights, "text", unknown=0.0).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op10_nearest_vectors")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    index = ann.build(table(spark, sf, "embeddings"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann.search(index, index.rows.filter("vec_id % 100 = 0"), 10)


@query("op11_quality_classifier")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality_net.fit(docs, table(spark, sf, "labels"))
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality_net.score(model, "text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
