"""Operators of a training-data pipeline: filtering, deduplication, redaction, tokenising, packing."""
