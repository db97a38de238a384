"""Interchange formats: sidecar pairs and text embeddings. Parquet and the rest are Spark's own."""
