"""Clusters of window shapes by time warping: a distance matrix in blocks over tasks, and complete linkage by chains of nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.operators.patterns import k_means, silhouette

BLOCK = 64


def warped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Time-warping distance of each row of a to each row of b; all pairs go along one table together."""
    m, n = len(a), len(b)
    now = [np.full((m, n), np.inf) for _ in range(b.shape[1] + 1)]
    now[0] = np.zeros((m, n))
    for i in range(a.shape[1]):
        before, now = now, [np.full((m, n), np.inf)]
        for j in range(b.shape[1]):
            step = (a[:, i, None] - b[None, :, j]) ** 2
            now.append(step + np.minimum(np.minimum(before[j], before[j + 1]), now[j]))
    return np.sqrt(now[-1])


def complete_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters (all points, if fewer) by complete linkage, numbered by their first point. Chains of nearest neighbours find the merges; the lowest are taken."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            at = chain[-1]
            near = int(np.argmin(d[at]))
            if len(chain) > 1 and d[at, chain[-2]] <= d[at, near]:
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((d[a, b], len(merges), a, b))
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        alive[b] = False
    label = np.arange(n)
    for _, _, a, b in sorted(merges)[: max(0, n - k)]:
        low, high = sorted((label[a], label[b]))
        label[label == high] = low
    return np.unique(label, return_inverse=True)[1]


def warped_distances(windows: DataFrame) -> DataFrame:
    """(series_id, place, others, distances): distances of each window (series_id, place, window) of a series to those of the same and later blocks. A group for each two blocks; a window goes to as many groups as its series has blocks."""
    rows = windows.withColumn("_block", F.floor(F.col("place") / BLOCK).cast("int"))
    rows = rows.withColumn("_last", F.max("_block").over(Window.partitionBy("series_id")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    rows = rows.select("series_id", "place", "window", "_block", F.least("_block", "_other").alias("p"), F.greatest("_block", "_other").alias("q"))

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        low, high = frame[frame["_block"] == frame["p"]], frame[frame["_block"] == frame["q"]]
        apart = warped(np.stack(low["window"].to_numpy()), np.stack(high["window"].to_numpy()))
        return pd.DataFrame({"series_id": low["series_id"], "place": low["place"], "others": [high["place"].to_numpy()] * len(low), "distances": list(apart)})

    return rows.groupBy("series_id", "p", "q").applyInPandas(pair, "series_id string, place int, others array<int>, distances array<double>")


def warped_clusters(windows: DataFrame, k: int | None = None, most: int = 500, least: int = 3) -> DataFrame:
    """(series_id, start_bar, end_bar, cluster, similarity): clusters of the windows (series_id, start_bar, end_bar, window, of one width) of each series by complete linkage of their time-warping distances; similarity is the cosine with the cluster's mean.

    k is that of the largest silhouette of plain clusters, from 2 to min(12, windows / 5), if not given. Series of more than most windows are clustered by k-means, as linkage needs a whole matrix in one task; clusters of fewer than least windows are left out.
    """
    each = Window.partitionBy("series_id")
    rows = windows.withColumn("place", F.row_number().over(each.orderBy("start_bar")) - 1).withColumn("_n", F.count("*").over(each))
    apart = warped_distances(rows.where(F.col("_n") <= most).select("series_id", "place", "window"))

    def cluster(frame: pd.DataFrame, distances: pd.DataFrame) -> pd.DataFrame:
        columns = ["series_id", "start_bar", "end_bar", "cluster", "similarity"]
        frame = frame.sort_values("place", ignore_index=True)
        if len(frame) < 2 * least:
            return pd.DataFrame(columns=columns)
        shapes = np.stack(frame["window"].to_numpy())
        wanted = k or (max(range(2, min(min(12, len(shapes) // 5) + 1, len(shapes))), key=lambda c: silhouette(shapes, k_means(shapes, c)[0]), default=2) if len(shapes) >= 10 else 2)
        if len(distances):
            matrix = np.zeros((len(shapes), len(shapes)))
            for place, others, values in zip(distances["place"], distances["others"], distances["distances"], strict=True):
                matrix[place, others] = values
                matrix[others, place] = values
            label = complete_linkage(matrix, wanted)
        else:
            label = k_means(shapes, wanted, tries=10)[0]
        means = np.stack([shapes[label == c].mean(axis=0) if (label == c).any() else shapes[0] for c in range(label.max() + 1)])[label]
        cosine = (shapes * means).sum(axis=1) / np.maximum(np.linalg.norm(shapes, axis=1) * np.linalg.norm(means, axis=1), 1e-10)
        out = frame[["series_id", "start_bar", "end_bar"]].assign(cluster=label, similarity=cosine)
        return out[np.bincount(label)[label] >= least]

    kind = "series_id string, start_bar long, end_bar long, cluster int, similarity double"
    return rows.select("series_id", "place", "start_bar", "end_bar", "window").groupBy("series_id").cogroup(apart.groupBy("series_id")).applyInPandas(cluster, kind)
