"""Cycles: periodogram, autocorrelation, rescaled range, scoring, consensus inputs and turning points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import whole
from periodica.functions.series import per_series
from periodica.operators.cleaning import numbered


def periodogram(series: DataFrame, column: str, min_period: float = 5.0, max_period: float = 200.0) -> DataFrame:
    """Power of a Hann-tapered series at the frequencies k/n with periods between the bounds: (series_id, k, n, frequency, period, power, phase, amplitude).

    A fast transform of each series of at least 32 bars, power over its largest within the bounds; gaps count as 0.
    """

    def transform(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(frame[column].to_numpy(float, na_value=np.nan))
        n = len(x)
        k = np.arange(math.floor(n / max_period) + 1, min(math.ceil(n / min_period) - 1, n // 2) + 1)
        if n < 32 or not len(k):
            return pd.DataFrame(columns=["k", "n", "frequency", "period", "power", "phase", "amplitude"])
        wave = np.fft.rfft(x * np.hanning(n))[k]
        raw = np.abs(wave) ** 2
        power = raw / raw.max() if raw.max() > 0 else np.full(len(k), np.nan)
        return pd.DataFrame({"k": k, "n": n, "frequency": k / n, "period": n / k, "power": power, "phase": np.angle(wave), "amplitude": 2 * np.sqrt(power) / n})

    out = per_series(series, [column], transform, "k long, n long, frequency double, period double, power double, phase double, amplitude double")
    return out.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in ("power", "amplitude")})


def autocorrelation(series: DataFrame, column: str, max_lag: int = 60) -> DataFrame:
    """Mean-removed autocorrelation at lags 1 to max_lag, over the value at lag 0, and the 95 % bound of noise."""
    bars = numbered(series).select("series_id", "bar", (F.col(column) - F.avg(column).over(whole())).alias("x"), F.count("*").over(whole()).alias("n"))
    late = bars.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).select("series_id", "n", "lag", (F.col("bar") - F.col("lag")).alias("bar"), F.col("x").alias("y"))
    sums = late.join(bars.select("series_id", "bar", "x"), ["series_id", "bar"]).groupBy("series_id", "n", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    base = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(whole())
    return sums.select("series_id", "lag", (F.col("s") / base).alias("acf"), (1.96 / F.sqrt("n")).alias("bound")).where("lag > 0")


def peaks(spectrum: DataFrame, at: str, value: str, least: float) -> DataFrame:
    """Strict local maxima of value along at that reach least."""
    order = Window.partitionBy("series_id").orderBy(at)
    out = spectrum.withColumn("_before", F.lag(value).over(order)).withColumn("_after", F.lead(value).over(order))
    return out.where((F.col(value) > F.col("_before")) & (F.col(value) > F.col("_after")) & (F.col(value) >= least)).drop("_before", "_after")


def score(candidates: DataFrame, top: int = 20) -> DataFrame:
    """Strength of candidates (series_id, period, power, confidence, n) and their rank by it."""
    quarter = F.col("n") / 4
    near = F.least(F.greatest(1 - F.abs(F.col("period") - quarter) / quarter, F.lit(0.1)), F.lit(1.0))
    sure = F.when(F.col("confidence") == 0, 0.3).otherwise(F.col("confidence"))
    raw = 0.6 * F.col("power") / F.max("power").over(whole()) + 0.3 * sure + 0.1 * near
    out = candidates.withColumn("strength", F.round(F.least(raw, F.lit(1.0)), 4))
    return out.withColumn("rank", F.row_number().over(whole().orderBy(F.desc("strength"), "period"))).where(F.col("rank") <= top)


def turning_points(cycles: DataFrame) -> DataFrame:
    """Bars to the next peak or trough of cycles (period, phase), the nearer one; a tie is a peak."""
    full = 2 * math.pi
    to = lambda angle: F.floor(F.pmod(angle, F.lit(full)) / full * F.col("period"))
    peak, trough = to(-F.col("phase")), to(math.pi - F.col("phase"))
    return cycles.withColumn("next_turning_point_bars", F.least(peak, trough)).withColumn("turning_point_type", F.when(peak <= trough, "peak").otherwise("trough"))


def welch(series: DataFrame, column: str, segment: int = 256) -> DataFrame:
    """Mean power over half-overlapping, mean-removed, Hann-tapered segments of min(segment, n // 2) bars, over its largest: (series_id, k, length, period, power)."""
    bars = numbered(series).select("series_id", "bar", F.col(column).alias("x"), F.count("*").over(whole()).alias("n")).where("n >= 32")
    rows = bars.withColumn("length", F.least(F.lit(segment), F.floor(F.col("n") / 2))).withColumn("step", F.col("length") - F.floor(F.col("length") / 2))
    last = F.floor((F.col("n") - F.col("length")) / F.col("step"))
    low, high = F.greatest(F.ceil((F.col("bar") - F.col("length") + 1) / F.col("step")), F.lit(0)), F.least(F.floor(F.col("bar") / F.col("step")), last)
    rows = rows.where(high >= low).withColumn("part", F.explode(F.sequence(low, high))).withColumn("place", F.col("bar") - F.col("part") * F.col("step"))
    each = Window.partitionBy("series_id", "part")
    rows = rows.withColumn("w", (F.col("x") - F.avg("x").over(each)) * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("place") / F.col("length"))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("length") / 2))))
    angle = 2 * math.pi * (F.col("k") * F.col("place") % F.col("length")) / F.col("length")
    sums = rows.groupBy("series_id", "length", "part", "k").agg(F.sum(F.col("w") * F.cos(angle)).alias("re"), F.sum(F.col("w") * F.sin(angle)).alias("im"))
    mean = sums.groupBy("series_id", "length", "k").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    doubled = F.when(2 * F.col("k") == F.col("length"), F.col("p")).otherwise(2 * F.col("p"))
    return mean.withColumn("p", doubled).select("series_id", "k", "length", (F.col("length") / F.col("k")).alias("period"), (F.col("p") / F.max("p").over(whole())).alias("power"))


def lomb_scargle(series: DataFrame, column: str, min_period: float = 5.0, max_period: float = 200.0, grid: int = 500) -> DataFrame:
    """Generalised Lomb-Scargle power with a floating mean at grid frequencies between 1 / max_period and 1 / min_period: the share of variance that the best sine explains.

    Series of fewer than 32 values or without variance give none; gaps keep their places in time. One pass over each series, in steps of bounded size.
    """

    def explained(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[column].to_numpy(float, na_value=np.nan)
        t = np.flatnonzero(np.isfinite(x)).astype(float)
        y = x[np.isfinite(x)]
        none = pd.DataFrame(columns=["k", "frequency", "period", "power"])
        if len(y) < 32 or not y.var() > 0:
            return none
        y, n = y - y.mean(), len(y)
        frequency = 1 / max_period + np.arange(grid) * (1 / min_period - 1 / max_period) / (grid - 1)
        power, step = np.full(grid, np.nan), max(1, 2_000_000 // n)
        for at in range(0, grid, step):
            angle = 2 * np.pi * frequency[at : at + step, None] * t
            c, s = np.cos(angle), np.sin(angle)
            c, s = c - c.mean(axis=1, keepdims=True), s - s.mean(axis=1, keepdims=True)
            yc, ys, cc, ss, cs = c @ y / n, s @ y / n, (c * c).mean(axis=1), (s * s).mean(axis=1), (c * s).mean(axis=1)
            det = cc * ss - cs * cs
            with np.errstate(divide="ignore", invalid="ignore"):
                power[at : at + step] = np.where(det > 1e-12, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (y @ y / n * det), np.nan)
        ok = np.isfinite(power)
        return pd.DataFrame({"k": np.arange(grid)[ok], "frequency": frequency[ok], "period": 1 / frequency[ok], "power": power[ok]})

    return per_series(series, [column], explained, "k int, frequency double, period double, power double")
