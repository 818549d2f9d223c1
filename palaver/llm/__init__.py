"""Operators of a training-data pipeline: deduplication, tokens, language, vectors, shards, scores and packing."""
