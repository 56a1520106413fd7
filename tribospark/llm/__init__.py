"""Operators of a training-data pipeline: deduplication, filters, formatting, mixing, tokens, scores."""
