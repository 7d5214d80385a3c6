"""docweave: document-corpus ingest, enrichment and export on Spark DataFrames."""
