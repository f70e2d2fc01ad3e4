"""Operators of a training-data pipeline: filtering, deduplication, mixing, counting, packing and formatting."""
