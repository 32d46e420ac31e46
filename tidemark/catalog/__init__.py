"""Registered queries and their SQL twins."""

from tidemark.catalog import history, search, sources, streams, texts  # noqa: F401
from tidemark.catalog.base import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "b10_filtered_search"
