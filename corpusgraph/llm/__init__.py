"""Operators of a training-data pipeline: sharding, extraction, scoring, deduplication, mixing, tokens, media, search."""
