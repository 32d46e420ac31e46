"""Messages to articles, articles to documents, documents to chunk rows with vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.records import content_id, parse_rfc3339
from tidemark.functions.text import clean_all, let
from tidemark.functions.vectors import has_dimension, hash_embedding
from tidemark.operators.versions import latest_by
from tidemark.schemas import METADATA

REQUIRED_TEXT = ("headline", "summary", "author", "content", "source")


def _is_text(message: Column, field: str) -> Column:
    return F.schema_of_variant(F.variant_get(message, f"$.{field}", "variant")) == "STRING"


def _article(message: Column) -> Column:
    """One parsed message with its ``valid`` flag. A required field must be there; ``url`` may be an explicit null."""
    text = {f: F.try_variant_get(message, f"$.{f}", "string") for f in REQUIRED_TEXT}
    number = F.try_variant_get(message, "$.id", "bigint")
    url = F.variant_get(message, "$.url", "variant")
    symbols = F.try_variant_get(message, "$.symbols", "array<string>")
    created = parse_rfc3339(F.try_variant_get(message, "$.created_at", "string"))
    updated = parse_rfc3339(F.try_variant_get(message, "$.updated_at", "string"))
    valid = number.isNotNull() & created.isNotNull() & updated.isNotNull() & symbols.isNotNull() & url.isNotNull()
    valid = valid & (F.is_variant_null(url) | (F.schema_of_variant(url) == "STRING"))
    for f in REQUIRED_TEXT:
        valid = valid & _is_text(message, f)
    valid = valid & ~F.exists(symbols, lambda s: s.isNull())
    return F.struct(
        number.alias("id"),
        text["headline"].alias("headline"),
        text["summary"].alias("summary"),
        text["author"].alias("author"),
        created.alias("created_at"),
        updated.alias("updated_at"),
        F.try_variant_get(message, "$.url", "string").alias("url"),
        text["content"].alias("content"),
        symbols.alias("symbols"),
        text["source"].alias("source"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def parse_messages(batches: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Explode JSON payloads (a list or a single object) to one row per message with ``valid`` and ``batch_valid``.

    A payload that is no JSON at all gives one invalid row, so that nothing disappears silently.
    """
    raw = F.trim(F.col(payload))
    listed = F.when(F.startswith(raw, F.lit("[")), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    parsed = F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")
    articles = F.transform(parsed, _article)
    broken = F.array(_article(F.try_parse_json(F.lit("{}"))))
    rows = batches.select(*keep, F.col(payload), F.coalesce(articles, broken).alias("_articles")).withColumn(
        "batch_valid", F.forall("_articles", lambda a: a["valid"])
    )
    # the outer form, because Spark would test a plain explode's array for emptiness below, parsing everything twice
    exploded = rows.select(*keep, payload, "batch_valid", F.posexplode_outer("_articles").alias("position", "_a"))
    return exploded.where("position is not null").select(*keep, "position", "batch_valid", "_a.*", payload)


def validate(parsed: DataFrame, policy: str = "row") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). ``row`` rejects bad messages, ``batch`` rejects every message of a payload with a bad one."""
    if policy not in ("row", "batch"):
        raise ValueError(f"unknown policy: {policy}")
    good = F.col("valid") if policy == "row" else F.col("batch_valid")
    return parsed.where(good), parsed.where(~good)


def valid_counts(parsed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Accepted and rejected messages per payload."""
    return parsed.groupBy(batch).agg(
        F.count_if("valid").alias("valid_articles"), F.count_if(~F.col("valid")).alias("rejected_messages")
    )


def to_documents(articles: DataFrame, clean: Callable[[Column], Column] = clean_all) -> DataFrame:
    """Article rows to document rows: content id, the three cleaned texts in order, and the metadata."""
    return articles.select(
        content_id(F.col("content")).alias("id"),
        F.lit(None).cast("string").alias("group_key"),
        clean(F.col("headline")).alias("headline"),
        clean(F.col("summary")).alias("summary"),
        clean(F.col("content")).alias("_body"),
        "url",
        "symbols",
        "author",
        "created_at",
        "updated_at",
        "source",
        F.col("content").alias("full_raw_text"),
        F.col("id").alias("article_id"),
    ).select("*", F.array("headline", "summary", "_body").alias("text")).drop("_body")


def chunk_text(
    text: Column,
    budget: int = 384,
    buffer: int = 2,
    cost: str | Callable[[Column], Column] = "words",
    strict: bool = False,
    separator: str = " ",
) -> Column:
    """Greedy chunks of a text, in order; joined without separator they give the text back.

    ``cost`` prices one segment: ``words`` counts each as 1, ``chars`` by length, or pass a function. A segment dearer
    than the budget becomes a chunk of its own, or with ``strict`` stops the job.
    """
    if not 0 <= buffer < budget:
        raise ValueError("the buffer must be at least 0 and below the budget")
    room = budget - buffer

    def starts_of(segments: Column) -> Column:
        if cost == "words":
            last = F.floor((F.size(segments) - 1) / F.lit(room)).cast("int")
            return F.transform(F.sequence(F.lit(0), last), lambda i: i * F.lit(room) + F.lit(1))
        price = F.length if cost == "chars" else cost
        return _greedy_starts(F.transform(segments, lambda s: price(s).cast("bigint")), room, strict)

    def cut(segments: Column, starts: Column) -> Column:
        def piece(start: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1), F.size(segments) + 1)
            tail = F.when(end <= F.size(segments), F.lit(separator)).otherwise(F.lit(""))
            return F.concat(F.array_join(F.slice(segments, start, end - start), separator), tail)

        return F.filter(F.transform(starts, piece), lambda c: c != "")

    return let(F.split(text, separator, -1), lambda segments: let(starts_of(segments), lambda starts: cut(segments, starts)))


def _greedy_starts(costs: Column, room: int, strict: bool) -> Column:
    """1-based first segment of each chunk, by one pass over the prices."""
    zero = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("i")
    )

    def step(acc: Column, c: Column) -> Column:
        opens = (acc["i"] == 0) | ((acc["used"] + c > room) & (acc["used"] > 0))
        i = (acc["i"] + 1).cast("int")
        if strict:
            c = F.when(c > room, F.raise_error(F.lit("a segment is above the chunk budget")).cast("bigint")).otherwise(c)
        return F.struct(
            F.when(opens, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, c).otherwise(acc["used"] + c).alias("used"),
            i.alias("i"),
        )

    return F.aggregate(costs, zero, step, lambda acc: acc["starts"])


def compute_chunks(documents: DataFrame, **options) -> DataFrame:
    """One row per chunk: every text part is chunked alone, parts keep their order."""
    # never empty; the outer form keeps Spark from computing the texts once more to test that
    parts = documents.select("*", F.posexplode_outer("text").alias("part_no", "_part")).drop("text")
    return (
        parts.select("*", F.posexplode(chunk_text(F.col("_part"), **options)).alias("chunk_no", "text"))
        .drop("_part")
        .withColumn("chunk_id", content_id(F.col("text")))
    )


def compute_embeddings(
    chunks: DataFrame, embed: Callable[[Column], Column] | None = None, dim: int = 64, text: str = "text"
) -> DataFrame:
    """Add ``embedding``. ``embed`` maps a text column to a vector column; the default needs no model."""
    embed = embed or (lambda t: hash_embedding(t, dim))
    # through a one-element explode: a filter on the vector is then not pushed below it, where it would be computed twice
    made = chunks.withColumn("_vector", embed(F.col(text)))
    return made.select("*", F.explode_outer(F.array("_vector")).alias("embedding")).drop("_vector")


def to_points(chunks: DataFrame, dim: int, raw_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points ready to store, rows whose vector is missing or of another size).

    Points carry the metadata of their article; the raw text, as long as all its chunks together, only on request. It
    is in the document rows, one ``article_id`` away.
    """
    fits = has_dimension(F.col("embedding"), dim)
    metadata = [c for c in METADATA if c in chunks.columns and (raw_text or c != "full_raw_text")]
    columns = ["chunk_id", "text", "embedding", *metadata]
    return chunks.where(fits).select(*columns), chunks.where(~fits)


def zip_points(ids: Column, vectors: Column, payloads: Column) -> Column:
    """Positional zip cut to the shortest list."""
    shortest = F.least(F.size(ids), F.size(vectors), F.size(payloads))
    zipped = F.arrays_zip(ids.alias("id"), vectors.alias("vector"), payloads.alias("payload"))
    return F.slice(zipped, F.lit(1), shortest)


def ingest(
    articles: DataFrame, dim: int = 64, embed=None, order: Sequence[str] | None = None, **chunking
) -> tuple[DataFrame, DataFrame]:
    """Article rows to (points, rejects), one narrow plan without an exchange.

    With ``order`` equal chunks are merged before they are embedded, the last in that order stays: each text is embedded
    once, and vectors are not moved. A store that merges by ``chunk_id`` finds the rows dealt as it needs them.
    """
    chunks = compute_chunks(to_documents(articles), **chunking)
    if order is not None:
        chunks = latest_by(chunks.drop("full_raw_text"), ["chunk_id"], order)
    return to_points(compute_embeddings(chunks, embed, dim), dim)


def ingest_counters(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_distinct("chunk_id").alias("unique_chunk_ids"),
        F.count("text").alias("total_payloads"),
    )


def exact_duplicates(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """One row per distinct text: its md5, the smallest id, the number of copies. Copies merge before the shuffle."""
    return df.groupBy(content_id(F.col(text)).alias("content_id")).agg(
        F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
