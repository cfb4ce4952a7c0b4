"""Operators for large training-data pipelines: counts, filters, deduplication, packing."""
