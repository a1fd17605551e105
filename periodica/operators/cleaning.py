"""Cleaning, returns, detrending, scaling and volatility of series; every operator adds columns to bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import along, lag, rolling, whole
from periodica.functions.series import per_series

TRADING_DAYS = 252


def numbered(bars: DataFrame) -> DataFrame:
    """bar: place in the series, from 0."""
    return bars.withColumn("bar", F.row_number().over(along()) - 1)


def validate(bars: DataFrame) -> DataFrame:
    """Closes above 0, one row (the first by value) for each time."""
    first = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy("close"))
    return bars.where("close > 0 and not isnan(close)").withColumn("n", first).where("n = 1").drop("n")


def interpolate(bars: DataFrame, column: str = "close", most: int = 5, carry: int = 2) -> DataFrame:
    """Fill gaps of column: the first most of each by a straight line in time (past the last value: by that value), the next carry by the last filled value; rows still empty go. filled marks what was filled."""
    x = F.when(~F.isnan(column), F.col(column))
    before, after = along().rowsBetween(Window.unboundedPreceding, 0), along().rowsBetween(0, Window.unboundedFollowing)
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    has = lambda c: F.when(F.col("_x").isNotNull(), c)
    out = bars.withColumn("_x", x).withColumn("_t", at)
    out = out.withColumn("_island", F.count("_x").over(before))
    out = out.withColumn("_gap", F.row_number().over(Window.partitionBy("series_id", "_island").orderBy("ts")) - F.when(F.col("_island") > 0, 1).otherwise(0))
    for side, span, pick in (("0", before, F.last), ("1", after, F.first)):
        out = out.withColumn(f"_x{side}", pick("_x", True).over(span)).withColumn(f"_t{side}", pick(has(F.col("_t")), True).over(span))
    line = F.when(F.col("_x1").isNull(), F.col("_x0")).otherwise(F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0")))
    linear = F.coalesce("_x", F.when((F.col("_gap") <= most) & (F.col("_island") > 0), line))
    out = out.withColumn("_line", linear).withColumn("_carried", F.last("_line", True).over(before))
    value = F.coalesce("_line", F.when(F.col("_gap") <= most + carry, F.col("_carried")))
    out = out.withColumn("filled", F.col("_x").isNull()).withColumn(column, value).where(F.col(column).isNotNull())
    return out.drop("_x", "_t", "_island", "_gap", "_x0", "_t0", "_x1", "_t1", "_line", "_carried")


def winsorize(bars: DataFrame, column: str = "close", share: float = 0.005, to: str = "winsorized") -> DataFrame:
    """The int(share n) least and largest values of a series take the next value inwards; gaps stay gaps."""
    place = F.row_number().over(whole().orderBy(F.asc_nulls_last(column))) - 1
    cut = F.floor(F.lit(share) * F.count(column).over(whole()))
    out = bars.withColumn("_place", place).withColumn("_cut", cut).withColumn("_n", F.count(column).over(whole()))
    low = F.max(F.when(F.col("_place") == F.col("_cut"), F.col(column))).over(whole())
    high = F.max(F.when(F.col("_place") == F.col("_n") - F.col("_cut") - 1, F.col(column))).over(whole())
    return out.withColumn(to, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), low), high))).drop("_place", "_cut", "_n")


def iqr_clip(bars: DataFrame, column: str = "close", width: float = 3.0, to: str = "clipped") -> DataFrame:
    """Values outside the quartiles by more than width times their distance take that bound; gaps stay gaps."""
    quarter = lambda p: F.percentile(column, F.lit(p)).over(whole())
    spread = width * (quarter(0.75) - quarter(0.25))
    return bars.withColumn(to, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), quarter(0.25) - spread), quarter(0.75) + spread)))


def z_outliers(bars: DataFrame, column: str = "close", limit: float = 4.0) -> DataFrame:
    """Values at least limit population deviations from the mean become gaps, which are filled as in interpolate."""
    z = (F.col(column) - F.avg(column).over(whole())) / F.stddev_pop(column).over(whole())
    return interpolate(bars.withColumn(column, F.when(F.abs(z) < limit, F.col(column))), column)


def returns(bars: DataFrame, column: str = "close", period: int = 1) -> DataFrame:
    return bars.withColumn("simple_return", F.col(column) / lag(column, period) - 1).withColumn("log_return", F.ln(F.col(column) / lag(column, period)))


def detrend_linear(bars: DataFrame, column: str = "close", to: str = "detrended") -> DataFrame:
    """What remains over the least-squares line on the place in the series."""
    out = numbered(bars)
    slope, base = F.regr_slope(column, "bar").over(whole()), F.regr_intercept(column, "bar").over(whole())
    return out.withColumn(to, F.col(column) - base - slope * F.col("bar"))


def detrend_quadratic(bars: DataFrame, column: str = "close", to: str = "detrended") -> DataFrame:
    """What remains over the least-squares parabola on the place in the series, scaled to -1..1 and by orthogonal terms."""
    out = numbered(bars).withColumn("_t", F.when(F.max("bar").over(whole()) > 0, 2.0 * F.col("bar") / F.max("bar").over(whole()) - 1).otherwise(0.0))
    out = out.withColumn("_q", F.col("_t") * F.col("_t") - F.avg(F.col("_t") * F.col("_t")).over(whole()))
    fit = lambda c: F.coalesce(F.sum(F.col(column) * F.col(c)).over(whole()) / F.nullif(F.sum(F.col(c) * F.col(c)).over(whole()), F.lit(0.0)), F.lit(0.0)) * F.col(c)
    return out.withColumn(to, F.col(column) - F.avg(column).over(whole()) - fit("_t") - fit("_q")).drop("_t", "_q")


def detrend_rolling(bars: DataFrame, column: str = "close", width: int = 252, least: int = 63, to: str = "detrended") -> DataFrame:
    """What remains over the centred rolling mean; 0 where too few bars are near."""
    near = along().rowsBetween(-(width // 2), width - width // 2 - 1)
    trend = F.when(F.count(column).over(near) >= least, F.avg(column).over(near))
    return bars.withColumn(to, F.coalesce(F.col(column) - trend, F.lit(0.0)))


def normalize(bars: DataFrame, column: str, how: str = "robust", to: str = "normalized") -> DataFrame:
    x, each = F.col(column), whole()
    if how == "zscore":
        value = (x - F.avg(x).over(each)) / F.stddev_pop(x).over(each)
    elif how == "minmax":
        value = 2 * (x - F.min(x).over(each)) / (F.max(x).over(each) - F.min(x).over(each)) - 1
    elif how == "robust":
        part = lambda p: F.percentile(x, F.lit(p)).over(each)
        value = (x - part(0.5)) / (part(0.75) - part(0.25))
    else:
        raise ValueError(f"unknown scaling {how}")
    return bars.withColumn(to, value)


def volatility(bars: DataFrame, column: str = "log_return", width: int = 20, least: int = 10, to: str = "volatility") -> DataFrame:
    """Yearly rolling deviation; the first bars take the first value there is."""
    value = rolling(column, width, F.stddev_samp, least) * F.sqrt(F.lit(float(TRADING_DAYS)))
    out = bars.withColumn("_v", value)
    return out.withColumn(to, F.first("_v", True).over(along().rowsBetween(0, Window.unboundedFollowing))).drop("_v")


def adjust(bars: DataFrame, target: float = 0.16, most: float = 3.0) -> DataFrame:
    """Log returns scaled to a target volatility, at most most times."""
    daily = F.sqrt(F.lit(float(TRADING_DAYS)))
    scale = F.least(F.lit(target) / daily / F.greatest(F.col("volatility") / daily, F.lit(1e-8)), F.lit(most))
    return bars.withColumn("vol_adjusted", F.coalesce(F.col("log_return") * scale, F.lit(0.0)))


def preprocess(bars: DataFrame) -> DataFrame:
    """The chain: validate, fill, clip outliers of close and returns, detrend, scale, volatility."""
    out = iqr_clip(interpolate(validate(bars)), "close", to="close")
    out = iqr_clip(returns(out), "log_return", to="log_return")
    return adjust(volatility(normalize(detrend_hp(out), "detrended")))


def summary(bars: DataFrame) -> DataFrame:
    """Counts, range, returns, volatility, Sharpe ratio, deepest fall, and sample skewness (of 3 returns or more) and excess kurtosis (of 4) of each series."""
    out = returns(bars).withColumn("fall", (F.col("close") - F.max("close").over(along())) / F.max("close").over(along()))
    year = F.lit(float(TRADING_DAYS))
    grouped = out.groupBy("series_id").agg(
        F.count("*").alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.avg("close").alias("mean_close"),
        (F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("total_return"), (F.stddev_samp("log_return") * F.sqrt(year)).alias("annual_volatility"), (F.avg("log_return") * year).alias("annual_return"), F.min("fall").alias("max_drawdown"),
        F.count("log_return").alias("_n"), F.skewness("log_return").alias("_skew"), F.kurtosis("log_return").alias("_kurt"),
    )
    n = F.col("_n").cast("double")  # sample corrections of the population moments
    skew = F.when(n > 2, F.col("_skew") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("_kurt") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return grouped.withColumns({"sharpe": F.col("annual_return") / (F.col("annual_volatility") + 1e-10), "skewness": skew, "kurtosis": kurt}).drop("_n", "_skew", "_kurt")


def hp_trend(x: np.ndarray, smoothness: float) -> np.ndarray:
    """Trend of the Hodrick-Prescott filter: the solution of (I + smoothness D'D) t = x for second differences D, by one factorization of the five-banded matrix."""
    n = len(x)
    if n < 3:
        return x.copy()
    main, one, two = np.ones(n), np.zeros(n), np.zeros(n)
    main[: n - 2] += smoothness
    main[1 : n - 1] += 4 * smoothness
    main[2:] += smoothness
    one[: n - 2] -= 2 * smoothness
    one[1 : n - 1] -= 2 * smoothness
    two[: n - 2] += smoothness
    d, e, f, y = main.tolist(), one.tolist(), two.tolist(), x.tolist()
    for i in range(n):  # L D L' in place: d is D, e and f hold L below the diagonal
        if i >= 1:
            d[i] -= e[i - 1] ** 2 * d[i - 1]
            y[i] -= e[i - 1] * y[i - 1]
            if i + 1 < n:
                e[i] -= f[i - 1] * e[i - 1] * d[i - 1]
        if i >= 2:
            d[i] -= f[i - 2] ** 2 * d[i - 2]
            y[i] -= f[i - 2] * y[i - 2]
        if i + 1 < n:
            e[i] /= d[i]
        if i + 2 < n:
            f[i] /= d[i]
    t = [v / w for v, w in zip(y, d, strict=True)]
    for i in range(n - 2, -1, -1):
        t[i] -= e[i] * t[i + 1] + (f[i] * t[i + 2] if i + 2 < n else 0.0)
    return np.array(t)


def detrend_hp(bars: DataFrame, column: str = "close", smoothness: float = 1600.0, to: str = "detrended") -> DataFrame:
    """What remains over the Hodrick-Prescott trend of each series' values; gaps stay gaps."""
    kept = [f for f in bars.schema.fields if f.name not in ("series_id", to)]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[column].to_numpy(float, na_value=np.nan)
        out, ok = np.full(len(x), np.nan), np.isfinite(x)
        out[ok] = x[ok] - hp_trend(x[ok], smoothness)
        return frame[[f.name for f in kept]].assign(**{to: out})

    return per_series(bars, [f.name for f in kept if f.name != "ts"], run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {to} double")
