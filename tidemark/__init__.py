"""News-like text collections on Spark: ingest, vector search, freshness, versions, conflicts, feeds, threads."""
