"""Physical strategies, and the catalogue of queries with their oracles."""
