"""The filings stream: parse, drop repeats, enrich, write JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.feeds import enrich, parse_atom
from tidemark.sources.sinks import keyed_json
from tidemark.streaming.jobs import drain_updates, first_rows, put_batch


def fresh_filings(stream: DataFrame, order: str = "poll_ts", at_most: int | None = None) -> DataFrame:
    """The first row of every filing in a stream of feed documents ``(order column, xml)``."""
    return first_rows(parse_atom(stream, keep=(order,), at_most=at_most), ["id"], [order, "entry_no"]).drop(order, "entry_no")


def drain_filings(
    stream: DataFrame,
    tickers: DataFrame,
    filing_texts: DataFrame | None,
    out_path: str,
    checkpoint: str,
    order: str = "poll_ts",
    at_most: int | None = None,
) -> None:
    """Run the stream to its end; the output is ``key, value`` JSON lines, keyed by ticker. Reference tables are plain batch
    tables, read once per micro-batch."""

    def write(fresh: DataFrame, batch_id: int) -> None:
        put_batch(keyed_json(enrich(fresh, tickers, filing_texts), F.col("ticker")), out_path, batch_id)

    drain_updates(fresh_filings(stream, order, at_most), write, checkpoint)
