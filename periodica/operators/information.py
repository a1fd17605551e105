"""Mutual information of features and an aim by nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digamma(n: np.ndarray) -> np.ndarray:
    """Digamma function of whole numbers from 1: harmonic sums less Euler's constant."""
    sums = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, max(n.max(initial=1), 2)))])
    return sums[n - 1] - np.euler_gamma


def neighbour_radius(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Distance in the maximum norm of each point to its k-th nearest other one.

    Points stand in the order of x and meet those d places away on both sides, d = 1, 2, ..., until no point's k-th best exceeds its gap in x;
    that takes about the root of n rounds for scattered points, each over those that are still open.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(x)
    best = np.full((n, k), np.inf)
    open_, d = np.arange(n), 1
    while len(open_) and d < n:
        gap = np.full(len(open_), np.inf)
        for other in (open_ - d, open_ + d):
            inside = (other >= 0) & (other < n)
            own, far = open_[inside], other[inside]
            across = np.abs(x[far] - x[own])
            gap[inside] = np.minimum(gap[inside], across)
            apart = np.maximum(across, np.abs(y[far] - y[own]))
            nearer = apart < best[own, -1]
            own, apart = own[nearer], apart[nearer]
            best[own, -1] = apart
            best[own] = np.sort(best[own], axis=1)
        open_, d = open_[gap < best[open_, -1]], d + 1
    out = np.empty(n)
    out[order] = best[:, -1]
    return out


def within(v: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of v lie within the radius of each of them, itself included, by their differences (sums with the radius would round)."""
    line = np.sort(v)
    low, high = np.searchsorted(line, v - radius), np.searchsorted(line, v + radius)
    for edge, step, wrong in ((low, -1, lambda e: (e > 0) & (v - line[np.maximum(e - 1, 0)] <= radius)), (low, 1, lambda e: v - line[e] > radius), (high, -1, lambda e: line[np.maximum(e - 1, 0)] - v > radius), (high, 1, lambda e: (e < len(v)) & (line[np.minimum(e, len(v) - 1)] - v <= radius))):
        while (off := wrong(edge)).any():
            edge[off] += step
    return high - low


def kraskov(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of two samples in nats, at least 0: digamma(n) + digamma(k) less the means of the digammas of the points (each itself included) nearer than the k-th neighbour in x and in y. Both are first divided by their deviation."""
    n = len(x)
    if n <= k or x.std() == 0 or y.std() == 0:
        return 0.0
    x, y = x / x.std(), y / y.std()
    radius = np.nextafter(neighbour_radius(x, y, k), 0)
    means = sum(digamma(within(v, radius)).mean() for v in (x, y))
    return float(max(0.0, digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - means))


def mutual_information(features: DataFrame, names: list[str], aim: str = "target", k: int = 3) -> DataFrame:
    """(series_id, feature, n, mutual_info, mi_score) of each named column of features (series_id, ...) with aim, over rows where both have finite values; mi_score is relative to the largest of the series.

    Each feature of a series is a task's group of its own. Ties are left as they are (no noise is added), so repeated points have a radius of 0. Constant features and those of at most k rows have 0.
    """
    long = features.unpivot(["series_id", aim], names, "feature", "value").select("series_id", "feature", F.col("value").cast("double").alias("value"), F.col(aim).cast("double").alias("aim"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        both = frame[np.isfinite(frame["value"].astype(float)) & np.isfinite(frame["aim"].astype(float))]
        return pd.DataFrame({"series_id": frame["series_id"].iloc[:1], "feature": frame["feature"].iloc[:1], "n": len(both), "mutual_info": kraskov(both["value"].to_numpy(float), both["aim"].to_numpy(float), k)})

    out = long.groupBy("series_id", "feature").applyInPandas(run, "series_id string, feature string, n long, mutual_info double")
    return out.withColumn("mi_score", F.col("mutual_info") / (F.max("mutual_info").over(Window.partitionBy("series_id")) + 1e-10))
