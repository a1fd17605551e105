"""What a reader sees: modules asked for in plain words, labels and rounded rows of cycles, key findings, and reads over saved cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.operators.cleaning import TRADING_DAYS, iqr_clip, interpolate, returns, validate, volatility
from periodica.sources.bars import BARS_PER_DAY

#: Words of a request and the modules they ask for, in the order in which they are added.
REQUESTS = [
    (("cycle", "period", "frequency", "periodicity", "dominant"), ("cycle_detection", "stability")),
    (("pattern", "structure", "regime", "repeat"), ("pattern_discovery",)),
    (("analog", "similar", "historical", "past"), ("analog",)),
    (("planet", "astro", "lunar", "solar", "jupiter", "saturn"), ("planetary",)),
    (("feature", "predictor", "important", "factor", "driver"), ("features",)),
    (("hidden", "relationship", "correlation", "dependency"), ("features", "planetary", "cycle_detection")),
]
#: Modules of the free plan.
FREE = ("preprocessing", "cycle_detection")
#: Digits of the fields of a cycle.
DIGITS = {"period": 2, "period_calendar": 2, "frequency": 6, "amplitude": 6, "power": 4, "phase": 4, "strength": 4, "confidence": 4}
#: The column that each kind of analysis takes.
SERIES_OF = {"cycle": "detrended", "pattern": "normalized", "volatility": "volatility", "analog": "normalized", "ml": "vol_adjusted"}


def requested_modules(request: Column, free: Column | bool = False) -> Column:
    """Modules that a request in plain words asks for, preprocessing first, each once; of a free plan only those it has. A null request asks for preprocessing alone."""
    text, none = F.lower(request), F.array().cast("array<string>")
    asked = [F.when(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]), F.array(*map(F.lit, modules))).otherwise(none) for words, modules in REQUESTS]
    every = F.array_distinct(F.concat(F.array(F.lit("preprocessing")), *asked))
    limited = F.filter(every, lambda m: m.isin(*FREE))
    return F.when(F.lit(free) if isinstance(free, bool) else F.coalesce(free, F.lit(False)), limited).otherwise(every)


def analysis_column(kind: str) -> str:
    """The column of preprocessed bars for a kind of analysis; any other name is a column itself."""
    return SERIES_OF.get(kind, kind)


def metadata(bars: DataFrame) -> DataFrame:
    """One row a series on its preprocessing: (series_id, n_bars, start_ts, end_ts, missing_filled, outliers_clipped, min_close, max_close, annualized_vol).

    Clipped are log returns outside three quartile distances, after closes have been clipped likewise; the missing first return does not count. annualized_vol is the mean
    of the volatility column, which is yearly already, times the root of the year's bars once more, as users know it.
    """
    kept = iqr_clip(interpolate(validate(bars)), "close", to="close")
    clipped = volatility(iqr_clip(returns(kept), "log_return", to="_clipped"), "_clipped")
    return clipped.groupBy("series_id").agg(
        F.count("*").alias("n_bars"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count_if("filled").alias("missing_filled"), F.count_if(F.col("_clipped") != F.col("log_return")).alias("outliers_clipped"),
        F.min("close").alias("min_close"), F.max("close").alias("max_close"), (F.avg("volatility") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("annualized_vol"),
    )


def calendar_period(period: Column, interval: str) -> Column:
    """Days of a period in bars of an interval; unknown intervals count as days."""
    return period / BARS_PER_DAY.get(interval, 1.0)


def serialised(cycles: DataFrame) -> DataFrame:
    """Cycles with each field that is there rounded to its digits, halves to the even one."""
    return cycles.withColumns({c: F.bround(c, d) for c, d in DIGITS.items() if c in cycles.columns})


def strength_label(strength: Column) -> Column:
    return F.when(strength >= 0.7, "High").when(strength >= 0.4, "Medium").otherwise("Low")


def period_label(days: Column) -> Column:
    """A period of days in years, months, weeks or days."""
    whole = lambda x, unit: F.concat(F.floor(x + 0.5).cast("string"), F.lit(unit))
    return F.when(days >= 365, F.format_string("%.1fY", days / 365)).when(days >= 30, whole(days / 30, "M")).when(days >= 7, whole(days / 7, "W")).otherwise(whole(days, "D"))


def hurst_label(hurst: Column) -> Column:
    return F.when(hurst > 0.55, "Trending (persistent)").when(hurst < 0.45, "Mean-reverting").otherwise("Random walk")


def dominant_by_bucket(cycles: DataFrame, most: int = 5) -> DataFrame:
    """The strongest cycle of each label of its period (period_calendar), the most strong of each series of them, numbered by place; ties go to the shorter period."""
    named = cycles.withColumn("bucket", period_label(F.col("period_calendar")))
    first = Window.partitionBy("series_id", "bucket").orderBy(F.desc("strength"), "period")
    by_strength = Window.partitionBy("series_id").orderBy(F.desc("strength"), "period")
    best = named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return best.withColumn("place", F.row_number().over(by_strength)).where(F.col("place") <= most)


def _firsts(rows: DataFrame, order: list[Column], most: int, section: str, finding: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("series_id", F.lit(section).alias("section"), "place", finding.alias("finding"))


def key_findings(cycles: DataFrame | None = None, stable: DataFrame | None = None, projection: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """The report of each series as rows (series_id, section, place, finding), from those results that are given; at least one.

    cycles (series_id, period, strength, method): the 5 strongest. stable (series_id, period, stability_score, is_stable): the 5 most stable of those that are.
    projection (series_id, projected_5, confidence): the outlook over 5 bars, none at 0 or null. features (series_id, place, feature): the first 10 by name.
    """
    whole, parts = lambda x: F.bround(x, 0), []
    if cycles is not None:
        parts.append(_firsts(cycles, [F.desc("strength"), F.asc("period")], 5, "dominant_cycles", F.format_string("Dominant cycle detected: %.0f bars (strength=%.2f, method=%s)", whole("period"), "strength", "method")))
    if stable is not None:
        parts.append(_firsts(stable.where("is_stable"), [F.desc("stability_score"), F.asc("period")], 5, "stable_cycles", F.format_string("Stable cycle: %.0f bars (stability=%.2f)", whole("period"), "stability_score")))
    if projection is not None:
        way = F.when(F.col("projected_5") > 0, "bullish").otherwise("bearish")
        text = F.format_string("Historical analogs suggest %s outcome (5d projection: %.2f%%, confidence: %.0f%%)", way, F.col("projected_5") * 100, whole(F.col("confidence") * 100))
        parts.append(_firsts(projection.where("projected_5 <> 0"), [F.asc("projected_5")], 1, "outlook", text))
    if features is not None:
        parts.append(_firsts(features, [F.asc("place"), F.asc("feature")], 10, "top_features", F.col("feature")))
    if not parts:
        raise ValueError("no result to report on")
    return reduce(DataFrame.unionByName, parts)
