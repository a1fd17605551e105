"""Operators for preparing training data: search, deduplication, scoring, mixing and packing."""
