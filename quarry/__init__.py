"""Text-search analytics on Spark: ingest, index, ranked search, link graph and log folding as DataFrame, SQL and streaming plans."""
