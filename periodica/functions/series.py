"""Grouped kernels: work on one series as a whole, and small numeric pieces they use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_series(bars: DataFrame, columns: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function over the bars of each series in time, with series_id put before what it returns; schema names the columns it returns (DDL).

    A series is bounded and fits in a task; the series are dealt out by their id.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = function(frame.sort_values("ts", ignore_index=True))
        out.insert(0, "series_id", frame["series_id"].iloc[0])
        return out

    return bars.select("series_id", "ts", *columns).groupBy("series_id").applyInPandas(run, f"series_id string, {schema}")


def finite(values: pd.Series) -> np.ndarray:
    """Values without gaps, in order."""
    x = values.to_numpy(np.float64, na_value=np.nan)
    return x[np.isfinite(x)]


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height of each peak over the higher of the lowest values between it and the next higher value (or the end) on either side."""
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        low = left[-1] + 1 if len(left) else 0
        high = p + 1 + right[0] if len(right) else len(x)
        out[k] = x[p] - max(x[low : p + 1].min(), x[p:high].min())
    return out


def find_peaks(x: np.ndarray, height: float = -np.inf, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Places of local maxima (the middle of a flat top) of at least height and prominence; of peaks nearer than distance the higher stays, ties to the later."""
    if len(x) < 3:
        return np.zeros(0, int)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(x) != 0) + 1])
    ends = np.append(begins[1:], len(x)) - 1
    level = x[begins]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (begins[top] + ends[top]) // 2
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(peaks - peaks[k]) < distance
            near[k] = False
            keep &= ~near
    peaks = peaks[keep]
    return peaks[prominences(x, peaks) >= prominence]


def windows(x: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """All windows of width values at every step, as rows."""
    return np.lib.stride_tricks.sliding_window_view(x, width)[::step] if len(x) >= width else np.zeros((0, width))


def z_scored(rows: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Rows less their mean over their deviation; flat rows become zeros."""
    deviation = rows.std(axis=1, keepdims=True)
    return np.where(deviation < least, 0.0, (rows - rows.mean(axis=1, keepdims=True)) / np.where(deviation < least, 1.0, deviation))


def dtw(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Time-warping distance of query to every row: least sum of squared differences over monotone alignments, its root. All rows go along one table together."""
    before = np.full((len(rows), rows.shape[1] + 1), np.inf)
    before[:, 0] = 0.0
    for q in query:
        cost = (rows - q) ** 2
        now = np.full_like(before, np.inf)
        step = np.minimum(before[:, 1:], before[:, :-1])
        for j in range(rows.shape[1]):
            now[:, j + 1] = cost[:, j] + np.minimum(step[:, j], now[:, j])
        before = now
    return np.sqrt(before[:, -1])
