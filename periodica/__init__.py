"""Cycle research over many time series, expressed as Spark DataFrame operations."""
