"""Versioned key-value analytics on Spark: an append-only mutation log and the views derived from it."""
