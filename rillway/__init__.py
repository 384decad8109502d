"""rillway: strict JSON-to-columnar ingest and analytics on PySpark."""
