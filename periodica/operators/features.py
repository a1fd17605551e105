"""Technical and calendar features of bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.rolling import along, correlation, emas, lag, lead, rolling

HORIZONS = (1, 2, 3, 5, 10, 20, 40, 60, 120, 252)
EPS = 1e-10


def log_return(n: int, column: str = "close") -> Column:
    return F.ln(F.col(column) / lag(column, n))


def calendar(bars: DataFrame) -> DataFrame:
    day, month, week, year = F.weekday("ts"), F.month("ts"), F.weekofyear("ts"), F.dayofyear("ts")
    circle = lambda x, period: 2 * math.pi * x / period
    out = bars.withColumns({"hour": F.hour("ts") / 23, "weekday": day / 6, "monthday": F.dayofmonth("ts") / 31, "month": month / 12, "quarter": F.quarter("ts") / 4, "week": week / 52, "yearday": year / 365})
    for name, x, period in (("weekday", day, 7), ("month", month, 12), ("week", week, 52), ("yearday", year, 252)):
        out = out.withColumn(f"{name}_sin", F.sin(circle(x, period))).withColumn(f"{name}_cos", F.cos(circle(x, period)))
    end = F.to_date("ts") == F.last_day("ts")
    return out.withColumn("is_month_end", end.cast("int")).withColumn("is_quarter_end", (end & (month % 3 == 0)).cast("int"))


def momentum(bars: DataFrame) -> DataFrame:
    out = bars.withColumns({f"ret_{n}": log_return(n) for n in HORIZONS})
    out = out.withColumns({f"sign_{n}": F.signum(f"ret_{n}") for n in HORIZONS})
    return out.withColumn("momentum_5_20", F.col("ret_5") - F.col("ret_20")).withColumn("momentum_20_60", F.col("ret_20") - F.col("ret_60"))


def rolling_moments(bars: DataFrame) -> DataFrame:
    out = bars.withColumns({f"z_{n}": (F.col("close") - rolling("close", n, F.avg)) / (rolling("close", n, F.stddev_samp) + EPS) for n in (20, 60, 120)})
    out = out.withColumn("r", log_return(1)).withColumns({f"vol_{n}": rolling("r", n, F.stddev_samp) for n in (5, 10, 20, 40, 60, 120)})
    out = out.withColumns({f"vol_year_{n}": F.col(f"vol_{n}") * math.sqrt(252) for n in (5, 10, 20, 40, 60, 120)})
    for n in (20, 60):  # sample corrections of the population moments
        skew = rolling("r", n, F.skewness) * math.sqrt(n * (n - 1)) / (n - 2)
        kurt = ((n + 1) * rolling("r", n, F.kurtosis) + 6) * (n - 1) / ((n - 2) * (n - 3))
        out = out.withColumn(f"skew_{n}", skew).withColumn(f"kurt_{n}", kurt)
    out = out.withColumns({"vol_of_vol": rolling("vol_20", 20, F.stddev_samp), "vol_ratio_5_20": F.col("vol_5") / (F.col("vol_20") + EPS), "vol_ratio_20_60": F.col("vol_20") / (F.col("vol_60") + EPS)})
    return out.drop("r")


def rsi(bars: DataFrame) -> DataFrame:
    """Relative strength by simple averages of gains and losses."""
    change = F.col("close") - lag("close")
    out = bars.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
    for n in (7, 14, 21):
        rise = rolling("_gain", n, F.avg, n) / (rolling("_loss", n, F.avg, n) + EPS)
        out = out.withColumn(f"rsi_{n}", F.when(lag("close", n).isNotNull(), 100 - 100 / (1 + rise)))
    return out.drop("_gain", "_loss")


def bollinger(bars: DataFrame) -> DataFrame:
    out = bars
    for n in (20, 50):
        middle, wide = rolling("close", n, F.avg), 2 * rolling("close", n, F.stddev_samp)
        out = out.withColumns({f"upper_{n}": middle + wide, f"lower_{n}": middle - wide, f"percent_b_{n}": (F.col("close") - middle + wide) / (2 * wide + EPS), f"bandwidth_{n}": 2 * wide / (middle + EPS)})
    return out


def true_range(bars: DataFrame) -> DataFrame:
    before = lag("close")
    out = bars.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    for n in (14, 20):
        out = out.withColumn(f"atr_{n}", rolling("_tr", n, F.avg)).withColumn(f"atr_share_{n}", F.col(f"atr_{n}") / F.col("close"))
    return out.drop("_tr")


def volume_and_range(bars: DataFrame) -> DataFrame:
    mean = rolling("volume", 20, F.avg)
    out = bars.withColumns({"volume_ratio": F.col("volume") / (mean + EPS), "volume_z": (F.col("volume") - mean) / (rolling("volume", 20, F.stddev_samp) + EPS)})
    for n in (20, 52):
        low, high = rolling("low", n, F.min), rolling("high", n, F.max)
        out = out.withColumn(f"range_place_{n}", (F.col("close") - low) / (high - low + EPS))
    return out


def macd(bars: DataFrame) -> DataFrame:
    """Moving average convergence, and spreads of exponential averages as a share of close; each column is one pass over the series."""
    out = emas(bars, "close", (9, 12, 21, 26, 50, 55, 200)).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    out = out.withColumns({f"ema_spread_{a}_{b}": (F.col(f"ema_{a}") - F.col(f"ema_{b}")) / F.col("close") for a, b in ((9, 21), (21, 55), (50, 200))})
    out = out.drop(*[f"ema_{n}" for n in (9, 12, 21, 26, 50, 55, 200)])
    return emas(out, "macd", (9,)).withColumnRenamed("ema_9", "macd_signal").withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def rolling_autocorrelation(bars: DataFrame, width: int = 60) -> DataFrame:
    out = bars.withColumn("_r", log_return(1))
    for n in (1, 2, 3, 5, 10, 20):
        over = along().rowsBetween(-(width - n - 1), 0)
        value = F.when(F.count("_r").over(along().rowsBetween(-(width - 1), 0)) >= width, correlation("_r", f"_lag_{n}", over))
        out = out.withColumn(f"_lag_{n}", lag("_r", n)).withColumn(f"autocorrelation_{n}", value).drop(f"_lag_{n}")
    return out.drop("_r")


def target(bars: DataFrame, horizon: int = 5) -> DataFrame:
    return bars.withColumn("target", F.ln(lead("close", horizon) / F.col("close")))


def f_scores(features: DataFrame, names: list[str], aim: str = "target") -> DataFrame:
    """One-factor F statistic of each feature against aim, by series: r^2 / (1 - r^2) (n - 2); 0 where either is constant or r is 1."""
    long = features.unpivot(["series_id", aim], names, "feature", "value").where(F.col("value").isNotNull() & F.col(aim).isNotNull())
    grouped = long.groupBy("series_id", "feature").agg(correlation("value", aim).alias("r"), F.count("*").alias("n"))
    return grouped.withColumn("f_score", F.coalesce(F.try_divide(F.col("r") * F.col("r"), 1 - F.col("r") * F.col("r")) * (F.col("n") - 2), F.lit(0.0)))
