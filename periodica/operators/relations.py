"""Relations between series: lead and lag correlation, false discovery, analogs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import correlation
from periodica.functions.series import dtw, per_series, windows, z_scored
from periodica.functions.statistics import correlation_p
from periodica.operators.cleaning import numbered


def lag_correlation(left: DataFrame, right: DataFrame, most: int = 20, least: int = 30) -> DataFrame:
    """Pearson correlation of value in left (series_id, ts, value) with value in right at every lag in rows of the two series' common times: right's row stands lag rows before left's. Pairs of one series with itself are left out."""
    met = left.join(right.select(F.col("series_id").alias("other_id"), "ts", F.col("value").alias("other")), "ts").where("series_id != other_id")
    order = Window.partitionBy("series_id", "other_id").orderBy("ts")
    rows = met.select("series_id", "other_id", "value", "other", F.row_number().over(order).alias("bar"))
    lagged = rows.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select("series_id", "other_id", "lag", (F.col("bar") + F.col("lag")).alias("bar"), "other")
    out = rows.drop("other").join(lagged, ["series_id", "other_id", "bar"]).groupBy("series_id", "other_id", "lag").agg(correlation("value", "other").alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)
    return out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def lead_lag(features: DataFrame, target: DataFrame, most: int = 20, least: int = 30, least_finite: int = 20) -> DataFrame:
    """Pearson's and Spearman's correlation of each feature (series_id, feature, bar, value) with target (series_id, bar, value) at every lag, and their two-sided p: (series_id, feature, lag, n, pearson_r, pearson_p, spearman_r, spearman_p).

    Lags count the bars that both have; at a lag above 0 the feature leads. Ranks are taken within each alignment, ties at their mean. Alignments
    of fewer than least bars or of fewer than least_finite pairs of finite values are left out, and a constant side gives nulls. One shuffle deals rows out by series and
    feature; alignments, ranks and sums all keep that partitioning.
    """
    group = Window.partitionBy("series_id", "feature")
    along = group.orderBy("bar")
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as rows multiply after it, small partitions are not put together
    met = features.join(target.select("series_id", "bar", F.col("value").alias("_y")), ["series_id", "bar"]).repartition(parts, "series_id", "feature").withColumn("_bars", F.count("*").over(group))
    moved = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("_y", k) if k >= 0 else F.lag("_y", -k)).over(along).alias("y")) for k in range(-most, most + 1)])
    rows = met.withColumn("_moved", moved).where(F.col("value").isNotNull() & ~F.isnan("value")).select("series_id", "feature", F.col("value").alias("x"), "_bars", F.explode("_moved").alias("_m"))
    rows = rows.select("series_id", "feature", F.col("_m.lag").alias("lag"), "x", F.col("_m.y").alias("y")).where((F.col("_bars") - F.abs("lag") >= least) & F.col("y").isNotNull() & ~F.isnan("y"))
    one = Window.partitionBy("series_id", "feature", "lag")
    place = lambda c: F.rank().over(one.orderBy(c)) + (F.count("*").over(one.orderBy(c).rangeBetween(0, 0)) - 1) / 2.0
    rows = rows.withColumn("rx", place("x")).withColumn("ry", place("y"))
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    out = rows.groupBy("series_id", "feature", "lag").agg(F.count("*").alias("n"), r("x", "y").alias("pearson_r"), r("rx", "ry").alias("spearman_r")).where(F.col("n") >= least_finite)
    return out.select("series_id", "feature", "lag", "n", "pearson_r", correlation_p(F.col("pearson_r"), F.col("n")).alias("pearson_p"), "spearman_r", correlation_p(F.col("spearman_r"), F.col("n")).alias("spearman_p"))


def false_discovery(tests: DataFrame, p: str = "p", level: float = 0.05, by: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """Benjamini-Hochberg: corrected p and whether it is at most level, within the groups by. tests is read twice and must give the same p each time: what was summed in a shuffle is to be stored or checkpointed before. Values of p are counted first, so only distinct ones are ranked, by buckets of equal ratio (real ones crowd near 0) whose totals (some ten thousand rows a group at most) are summed before; p of 0 is a bucket of its own."""
    counts = tests.groupBy(*by, p).agg(F.count("*").alias("_k")).withColumn("_b", F.when(F.col(p) > 0, F.floor(F.ln(F.col(p)) * buckets)).otherwise(-(2**40)))
    keys = list(by)
    within = Window.partitionBy(*keys, "_b").orderBy(p)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_k").alias("_n"))
    totals = totals.select(*keys, "_b", (F.sum("_n").over(group.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("_m"))
    ranked = counts.join(totals, [*keys, "_b"]).withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_before") + F.sum("_k").over(within)))
    least = ranked.groupBy(*keys, "_b").agg(F.min("_raw").alias("_low"))
    least = least.select(*keys, "_b", F.min("_low").over(group.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    own = F.min("_raw").over(Window.partitionBy(*keys, "_b").orderBy(F.desc(p)))
    adjusted = ranked.join(least, [*keys, "_b"]).select(*keys, p, F.least(own, "_after", F.lit(1.0)).alias("corrected"))
    return tests.join(adjusted, [*keys, p]).withColumn("is_significant", F.col("corrected") <= level)


def historical_analogs(bars: DataFrame, column: str = "close", lookback: int = 60, top: int = 10, separation: int = 30, method: str = "multi", horizons: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Past windows of lookback + 1 bars most like the last one of each series, by the Euclidean distance of their z-scored values, by time warping (dtw), or by the mean of both (mean). multi, the default, is the mean of the methods that give a distance to every window, which is the Euclidean one: time warping takes no part in it. Those that begin within separation of a nearer one are left out, and none comes near the query.

    (series_id, rank, start_bar, end_bar, start_ts, end_ts, similarity, distance, forward_<h> for each horizon, direction). Forward
    returns are sums of log returns of close, 0 where the series ends before; no later bar takes part in the search.
    """
    ahead = [f"forward_{h}" for h in horizons]

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame[column].notna()].reset_index(drop=True)
        x, log_close = frame[column].to_numpy(float), np.log(frame["close"].to_numpy(float))
        names = ["rank", "start_bar", "end_bar", "start_ts", "end_ts", "similarity", "distance", *ahead, "direction"]
        begin = len(x) - 1 - lookback
        rows = windows(x, lookback + 1)[: max(0, begin - lookback - separation)]
        if not len(rows):
            return pd.DataFrame(columns=names)
        query, apart = z_scored(x[None, begin:])[0], []
        for low in range(0, len(rows), 16_384):
            shapes = z_scored(rows[low : low + 16_384])
            both = [np.linalg.norm(shapes - query, axis=1)] if method != "dtw" else []
            apart.append(np.mean(both + ([dtw(query, shapes)] if method in ("dtw", "mean") else []), axis=0))
        distance = np.concatenate(apart)
        left, picked = distance.copy(), []
        while len(picked) < max(50, top) and np.isfinite(left).any():
            at = int(np.argmin(left))
            picked.append(at)
            left[max(0, at - separation + 1) : at + separation] = np.inf
        largest = distance[picked[:50]].max() + 1e-10
        out = []
        for rank, at in enumerate(picked[:top]):
            end = at + lookback
            sums = [float(log_close[end + h] - log_close[end]) if end + h < len(x) - 1 else 0.0 for h in horizons]
            out.append((rank + 1, at, end, frame["ts"][at], frame["ts"][end], float(np.clip(1 - distance[at] / largest, 0, 1)), float(distance[at]), *sums, "up" if sums[0] > 0.005 else "down" if sums[0] < -0.005 else "sideways"))
        return pd.DataFrame(out, columns=names)

    kinds = ", ".join(f"{c} double" for c in ahead)
    return per_series(bars, list(dict.fromkeys([column, "close"])), find, f"rank int, start_bar int, end_bar int, start_ts timestamp_ntz, end_ts timestamp_ntz, similarity double, distance double, {kinds}, direction string")


def analog_projection(found: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 60)) -> DataFrame:
    """Forward returns of analogs weighed by similarity, and how far they agree: one row a series."""
    weight = F.col("similarity") / (F.sum("similarity").over(Window.partitionBy("series_id")) + 1e-10)
    out = found.withColumn("_w", weight).groupBy("series_id").agg(*[F.sum(F.col("_w") * F.col(f"forward_{h}")).alias(f"projected_{h}") for h in horizons], F.stddev_pop(f"forward_{horizons[0]}").alias("_s"), F.count("*").alias("n_analogs"))
    return out.withColumn("confidence", F.least(F.greatest(1 - 10 * F.col("_s"), F.lit(0.1)), F.lit(0.99))).drop("_s")


def analogs(bars: DataFrame, column: str = "close", width: int = 20, step: int = 5, top: int = 5) -> DataFrame:
    """Past windows of each series most alike its last one, by cosine of z-scored values; windows that overlap the last are left out."""
    out = numbered(bars).withColumn("_n", F.count("*").over(Window.partitionBy("series_id")))
    over = Window.partitionBy("series_id").orderBy("bar").rowsBetween(0, width - 1)
    rows = out.withColumn("w", F.collect_list(F.col(column).cast("double")).over(over)).where((F.size("w") == width) & ((F.col("bar") % step == 0) | (F.col("bar") == F.col("_n") - width)))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    rows = rows.withColumn("_m", total("w", lambda v: v) / width)
    rows = rows.withColumn("w", F.transform("w", lambda v: v - F.col("_m"))).withColumn("_l", F.sqrt(total("w", lambda v: v * v))).where("_l > 1e-8")
    rows = rows.withColumn("w", F.transform("w", lambda v: v / F.col("_l"))).select("series_id", "bar", "_n", "w")
    last = rows.where(F.col("bar") == F.col("_n") - width).select("series_id", F.col("w").alias("q"))
    dot = F.aggregate(F.zip_with("w", "q", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    met = rows.where(F.col("bar") + width <= F.col("_n") - width).join(last, "series_id").withColumn("similarity", dot)
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("similarity"), "bar"))
    return met.withColumn("rank", place).where(F.col("rank") <= top).select("series_id", "rank", F.col("bar").alias("start_bar"), (F.col("bar") + width - 1).alias("end_bar"), "similarity")
