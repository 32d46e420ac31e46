"""Small expressions over ids, numbers, dates, links and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label of a title without a number, and the address of filings.
NO_CIK = "No CIK found"
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
OWNERSHIP_FORMS = ("3", "4", "5")


def content_id(text: Column) -> Column:
    return F.md5(text)


def parse_rfc3339(text: Column) -> Column:
    return F.try_to_timestamp(text)


def relative_difference(a: Column, b: Column) -> Column:
    """Null when both are zero."""
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def numeric_literal(text: Column) -> Column:
    """Value of a text that is digits once its dots are gone, else null."""
    return F.when(text.rlike(r"^\.*[0-9][0-9.]*$"), text.try_cast("double"))


def cik_of_title(title: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(title, r"\((\d+)\)", 1), F.lit("")), F.lit(NO_CIK))


def accession_id(urn: Column) -> Column:
    return F.replace(F.element_at(F.split(urn, "="), -1), F.lit("-"), F.lit(""))


def filing_text_url(link: Column) -> Column:
    """Address of a filing's full text; null for a link with too few parts."""
    parts = F.split(link, "/")
    name = F.replace(F.try_element_at(parts, F.lit(-1)), F.lit("-index.htm"), F.lit(".txt"))
    return F.concat(F.lit(ARCHIVE + "/"), F.get(parts, 6), F.lit("/"), F.get(parts, 7), F.lit("/"), name)


def issuer_symbol(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)<issuerTradingSymbol>(.*?)</issuerTradingSymbol>", 1), F.lit(""))


def is_ownership_form(form_type: Column) -> Column:
    return F.coalesce(form_type.isin(*OWNERSHIP_FORMS), F.lit(False))


def first_or_null(values: Column) -> Column:
    return F.get(values, 0)


def or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def merge_maps(base: Column, more: Column) -> Column:
    """Both maps as one; the value of ``more`` wins for a key that both have."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)
