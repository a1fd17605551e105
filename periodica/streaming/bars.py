"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bars(ticks: DataFrame, window: Column, late: str) -> DataFrame:
    rows = ticks.withWatermark("ts", late).groupBy("series_id", window.alias("window"))
    out = rows.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("price").cast("double").alias("volume"))
    return out.select("series_id", F.col("window.start").alias("ts"), F.col("window.end").alias("end_ts"), "open", "high", "low", "close", "volume")


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars of a stream (series_id, ts timestamp, price): a bar is final, and its state is dropped, once the watermark has passed it."""
    return _bars(ticks, F.window("ts", width), late).drop("end_ts")


def sliding_bars(ticks: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """Overlapping bars of width, one begun every step."""
    return _bars(ticks, F.window("ts", width, step), late)


def session_bars(ticks: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A bar for each run of ticks of a series with no pause of gap."""
    return _bars(ticks, F.session_window("ts", gap), late)


def once(ticks: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first of ticks with equal keys; state is dropped once the watermark has passed."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
