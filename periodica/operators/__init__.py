"""Operators over bars keyed by series_id and ts."""
