"""Filing feeds: parse, de-duplicate, enrich with tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.records import accession_id, cik_of_title, filing_text_url, is_ownership_form, issuer_symbol
from tidemark.schemas import FEED
from tidemark.session import materialize

NO_TICKER = "no_ticker"  # fixed value
SPREAD = 1024  # rows without a join key are spread over this many keys that match nothing


def parse_atom(feeds: DataFrame, xml: str = "xml", keep: tuple[str, ...] = (), at_most: int | None = None) -> DataFrame:
    """Feed documents to filing entries: all of them, or the first ``at_most`` of each document."""
    entries = F.from_xml(F.col(xml), FEED)["entry"]
    if at_most is not None:
        entries = F.slice(entries, 1, at_most)
    rows = feeds.select(*keep, F.posexplode(entries).alias("entry_no", "e"))
    page = F.filter("e.link", lambda link: link["_type"] == "text/html")
    return rows.select(
        *keep,
        "entry_no",
        accession_id(F.col("e.id")).alias("id"),
        F.col("e.title").alias("title"),
        F.get(page, 0)["_href"].alias("link"),
        cik_of_title(F.col("e.title")).alias("cik"),
        F.get("e.category", 0)["_term"].alias("form_type"),
    )


def first_occurrences(rows: DataFrame, key: str, arrival: Column) -> DataFrame:
    """The earliest row of every key; tasks pre-aggregate, so copies merge before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*rest), arrival).alias("_r"))
    return picked.select(key, "_r.*").select(*rows.columns)


def read_ticker_table(documents: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Index-oriented JSON (``{"0": {cik_str, ticker, title}, ...}``) to rows."""
    parsed = F.from_json(F.col(text), "map<string,struct<cik_str:bigint,ticker:string,title:string>>")
    return documents.select(*keep, F.explode(parsed).alias("position", "t")).select(*keep, "position", "t.*")


def one_ticker_per_cik(tickers: DataFrame) -> DataFrame:
    return tickers.groupBy(F.col("cik_str").alias("_cik")).agg(F.min("ticker").alias("_ticker"))


def lookup_tickers(filings: DataFrame, tickers: DataFrame) -> DataFrame:
    """Left join on the numeric CIK; ``ticker`` is null when unmatched.

    Spark broadcasts the reference side when its measured size allows and splits hot keys of a sort-merge join; rows
    without a CIK get keys that match nothing, so that they do not meet in one task.
    """
    cik = F.col("cik").try_cast("bigint")
    nowhere = F.lit(-1) - F.pmod(F.xxhash64("id"), F.lit(SPREAD))
    keyed = filings.withColumn("_cik", F.coalesce(cik, nowhere))
    return keyed.join(one_ticker_per_cik(tickers), "_cik", "left").withColumnRenamed("_ticker", "ticker").drop("_cik")


def enrich(filings: DataFrame, tickers: DataFrame, filing_texts: DataFrame | None = None) -> DataFrame:
    """Filings with ``ticker``: from the table, for ownership forms from the filing's own text, else ``no_ticker``.

    Only ownership forms without a ticker ask the texts; one whose text is missing or names no symbol is dropped. ``filing_texts`` has ``url, text``; of
    several texts of an address the smallest symbol counts.
    """
    found = lookup_tickers(filings, tickers)
    if filing_texts is None:
        return found.withColumn("ticker", F.coalesce("ticker", F.lit(NO_TICKER)))
    asks = F.col("ticker").isNull() & F.coalesce(is_ownership_form(F.col("form_type")), F.lit(False))
    found = materialize(found.withColumn("_asks", asks))  # read twice; what does not ask is not moved again
    settled = found.where("not _asks").withColumn("ticker", F.coalesce("ticker", F.lit(NO_TICKER)))
    asking = found.where("_asks").withColumn("_url", filing_text_url(F.col("link"))).where("_url is not null")
    symbols = filing_texts.select(F.col("url").alias("_url"), issuer_symbol(F.col("text")).alias("_symbol"))
    symbols = symbols.groupBy("_url").agg(F.min("_symbol").alias("_symbol")).where("_symbol is not null")
    told = asking.join(symbols, "_url").withColumn("ticker", F.col("_symbol"))
    return settled.drop("_asks").unionByName(told.select(settled.drop("_asks").columns))
