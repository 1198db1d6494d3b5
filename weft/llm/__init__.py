"""Operators for large-scale training-data pipelines: deduplication, mixing, language ID, WARC, extraction."""
