"""Operators for training-data pipelines: filtering, search, deduplication, mixing, packing and formatting.

Nothing outside this package imports it. ``llm.queries`` registers its queries.
"""
