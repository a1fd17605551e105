"""Whether a cycle persists: its power over hopping windows and out of sample."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import whole
from periodica.functions.series import finite, per_series
from periodica.operators.cleaning import numbered


def cycle_power(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the power of each group of rows (place from 0, n, x, period) in the three frequencies around 1/period; 0 for fewer than 10 rows or a period below 2. The total follows from Parseval's sum, so three frequencies are enough."""
    taper = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("place") / (F.col("n") - 1))
    near = F.ceil(F.col("n") / F.col("period") - 0.5)  # of two frequencies as near, the lower
    out = rows.where("n >= 10 and period >= 2").withColumn("w", F.col("x") * taper).withColumn("k0", near)
    wave = lambda k, f: F.sum(F.col("w") * f(2 * math.pi * k * F.col("place") / F.col("n")))
    power = lambda k: wave(k, F.cos) * wave(k, F.cos) + wave(k, F.sin) * wave(k, F.sin)
    bins = [F.col("k0") + d for d in (-1, 0, 1)]
    half = F.max(F.floor(F.col("n") / 2))
    even = F.max(F.col("n") % 2) == 0
    sums = out.groupBy(*keys, "n", "period", "k0").agg(
        *[power(k).alias(f"p{i}") for i, k in enumerate(bins)], (F.max("n") * F.sum(F.col("w") * F.col("w"))).alias("all"), (F.sum("w") * F.sum("w")).alias("zero"),
        F.when(even, F.pow(F.sum(F.col("w") * F.when(F.col("place") % 2 == 0, 1.0).otherwise(-1.0)), 2)).otherwise(0.0).alias("last"), half.alias("half"),
    )
    inside = lambda i: F.when((F.col("k0") + i - 1 >= 0) & (F.col("k0") + i - 1 <= F.col("half")), F.col(f"p{i}")).otherwise(0.0)
    total = (F.col("all") + F.col("zero") + F.col("last")) / 2
    return sums.select(*keys, "n", "period", F.greatest((inside(0) + inside(1) + inside(2)) / (total + 1e-10), F.lit(0.0)).alias("power"))


def walk_forward(bars: DataFrame, cycles: DataFrame, column: str = "close", detected: float = 0.01) -> DataFrame:
    """Hopping windows of a fifth of each series (60 bars at least) for each cycle (series_id, period): windows with the cycle over all, mean power and spread where it was found, and the trend of its power over all windows with half-life.

    A cycle counts as found only in windows of three periods or more; its trend takes every window. Each cycle of a series with bars gives a row:
    without windows, or where none finds it, the rate is 0 and the variation 1; fewer than four windows give no decay.
    Bars meet their windows by an equi-join on exploded window numbers, at most four or so for each bar.
    """
    rows = numbered(bars).select("series_id", "bar", F.col(column).alias("v"), F.count("*").over(whole()).alias("total"))
    width = F.greatest(F.floor(F.col("total") / 5), F.lit(60))
    step = F.greatest(F.floor(width / 4), F.lit(10))
    rows = rows.withColumn("n", width).withColumn("step", step)
    wanted = cycles.select("series_id", "period").distinct()
    series = rows.groupBy("series_id").agg(F.max("step").alias("step"), F.greatest(F.floor((F.max("total") - F.max("n")) / F.max("step")), F.lit(1)).alias("n_windows"))
    last = F.floor((F.col("total") - F.col("n") - 1) / F.col("step"))
    low, high = F.greatest(F.ceil((F.col("bar") - F.col("n") + 1) / F.col("step")), F.lit(0)), F.least(F.floor(F.col("bar") / F.col("step")), last)
    rows = rows.where((F.col("total") > F.col("n")) & (high >= low)).withColumn("window", F.explode(F.sequence(low, high)))
    rows = rows.withColumn("place", F.col("bar") - F.col("window") * F.col("step")).join(wanted, "series_id")
    power = cycle_power(rows.withColumnRenamed("v", "x"), ["series_id", "window"])
    hit = (F.col("power") > detected) & (F.col("n") >= F.greatest(F.lit(20), 3 * F.col("period")))
    found = power.groupBy("series_id", "period").agg(
        F.count_if(hit).alias("_hits"), F.avg(F.when(hit, F.col("power"))).alias("power_mean"), F.stddev_pop(F.when(hit, F.col("power"))).alias("power_std"), F.count("*").alias("_all"),
        F.regr_slope("power", "window").alias("slope"), F.regr_intercept("power", "window").alias("intercept"),
    )
    out = wanted.join(series, "series_id").join(found, ["series_id", "period"], "left").na.fill(0, ["_hits", "_all"]).na.fill(0.0, ["power_mean", "power_std"])
    out = out.withColumn("detection_rate", F.col("_hits") / F.col("n_windows")).withColumn("period_cv", F.when(F.col("_hits") > 0, 0.0).otherwise(1.0))
    enough = F.col("_all") >= 4
    out = out.withColumn("decay_per_year", F.when(enough, -F.col("slope") * 252 / F.col("step")).otherwise(0.0))
    fades = enough & (F.col("slope") < 0) & (F.col("intercept") > 0)
    return out.withColumn("half_life_bars", F.when(fades, F.floor(F.col("intercept") / (2 * F.abs("slope")) * F.col("step")).cast("long"))).drop("_hits", "_all")


def out_of_sample(bars: DataFrame, cycles: DataFrame, column: str = "close", share: float = 0.7) -> DataFrame:
    """Power of each cycle in the first share of its series and in the rest, and their ratio held to 0..2."""
    rows = numbered(bars).select("series_id", "bar", F.col(column).alias("x"), F.count("*").over(whole()).alias("total")).withColumn("cut", F.floor(F.col("total") * share))
    early = F.col("bar") < F.col("cut")
    rows = rows.withColumn("side", F.when(early, "is").otherwise("oos")).withColumn("place", F.when(early, F.col("bar")).otherwise(F.col("bar") - F.col("cut"))).withColumn("n", F.when(early, F.col("cut")).otherwise(F.col("total") - F.col("cut")))
    power = cycle_power(rows.join(cycles.select("series_id", "period"), "series_id"), ["series_id", "side"])
    out = power.groupBy("series_id", "period").agg(F.max(F.when(F.col("side") == "is", F.col("power"))).alias("is_power"), F.max(F.when(F.col("side") == "oos", F.col("power"))).alias("oos_power"))
    return out.withColumn("oos_ratio", F.least(F.greatest(F.col("oos_power") / (F.col("is_power") + 1e-10), F.lit(0.0)), F.lit(2.0)))


def stability_score(rate: Column, period_cv: Column, ratio: Column, percentile: Column) -> Column:
    """Detection, evenness of the period, out-of-sample ratio and rank among surrogates, weighed together."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return 0.35 * clip(rate) + 0.20 * clip(1 - 2 * period_cv) + 0.25 * clip(1 - F.abs(ratio - 0.8) / 0.8) + 0.20 * clip((percentile - 0.8) / 0.2)


def variance_thirds(bars: DataFrame, column: str = "log_return") -> DataFrame:
    """Population variances of the first quarter, the middle half and the last quarter of each series, with their ratios."""
    rows = numbered(bars).withColumn("part", F.col("bar") / F.count("*").over(whole()))
    var = lambda low, high: F.var_pop(F.when((F.col("part") >= low) & (F.col("part") < high), F.col(column)))
    out = rows.groupBy("series_id").agg(var(0, 0.25).alias("v1"), var(0.25, 0.75).alias("v2"), var(0.75, 1).alias("v3"))
    out = out.withColumn("ratio_12", F.round(F.col("v1") / (F.col("v2") + 1e-10), 4)).withColumn("ratio_23", F.round(F.col("v2") / (F.col("v3") + 1e-10), 4))
    return out.withColumn("variance_stability", F.least(F.greatest(1 - 0.5 * F.abs(1 - F.col("ratio_12")), F.lit(0.0)), F.lit(1.0)))


def share_at(rows: np.ndarray, period: float) -> np.ndarray:
    """Share of the Hann-tapered power of each row in the three frequencies around 1 / period; 0 for fewer than 10 values or a period below 2."""
    n = rows.shape[1]
    if n < 10 or period < 2:
        return np.zeros(len(rows))
    power = np.abs(np.fft.rfft(rows * np.hanning(n), axis=1)) ** 2
    at = int(np.argmin(np.abs(np.fft.rfftfreq(n) - 1 / period)))
    return power[:, max(0, at - 1) : at + 2].sum(axis=1) / (power.sum(axis=1) + 1e-10)


def surrogates(bars: DataFrame, cycles: DataFrame, column: str = "close", draws: int = 200, seed: int = 42) -> DataFrame:
    """(series_id, period, percentile, is_significant): share of phase-randomized surrogates of each series in which its cycle (series_id, period) has less power. Seeded, so reruns agree."""

    def rank(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or wanted.empty:
            return pd.DataFrame(columns=["series_id", "period", "percentile"])
        x = finite(frame.sort_values("ts")[column])
        periods = wanted["period"].drop_duplicates().to_numpy()
        size, random, below = np.abs(np.fft.rfft(x)), np.random.default_rng(seed), np.zeros(len(periods))
        own = np.array([share_at(x[None], p)[0] for p in periods])
        step = max(1, 4_000_000 // max(len(x), 1))
        for low in range(0, draws, step):
            turn = np.exp(1j * random.uniform(0, 2 * np.pi, (min(step, draws - low), len(size))))
            turn[:, 0] = 1.0
            if len(size) % 2 == 0:
                turn[:, -1] = 1.0
            null = np.fft.irfft(size * turn, n=len(x), axis=1)
            below += [(share_at(null, p) < o).sum() for p, o in zip(periods, own, strict=True)]
        return pd.DataFrame({"series_id": wanted["series_id"].iloc[0], "period": periods, "percentile": below / draws})

    met = bars.select("series_id", "ts", column).groupBy("series_id").cogroup(cycles.select("series_id", "period").groupBy("series_id")).applyInPandas(rank, "series_id string, period double, percentile double")
    return met.withColumn("is_significant", F.col("percentile") > 0.95)


def stability(bars: DataFrame, cycles: DataFrame, column: str = "close", draws: int = 200, seed: int = 42, stable_from: float = 0.5) -> DataFrame:
    """All tests of each cycle (series_id, period) together: walk-forward, out of sample, decay, surrogates, and the score with whether it reaches stable_from."""
    names = ["series_id", "period"]
    walk = walk_forward(bars, cycles, column).drop("step", "slope", "intercept")
    sample = out_of_sample(bars, cycles, column)
    out = cycles.select(names).distinct().join(walk, names, "left").join(sample, names, "left").join(surrogates(bars, cycles, column, draws, seed), names, "left")
    out = out.na.fill(0.0, ["detection_rate", "power_mean", "power_std", "decay_per_year", "is_power", "oos_power", "oos_ratio"]).na.fill(1.0, ["period_cv"])
    raw = F.col("oos_power") / (F.col("is_power") + 1e-10)
    out = out.withColumn("stability_score", stability_score(F.col("detection_rate"), F.col("period_cv"), raw, F.col("percentile")))
    return out.withColumn("is_stable", F.col("stability_score") >= stable_from)


def detected_stability(bars: DataFrame, found: DataFrame, column: str = "close", most: int = 15, draws: int = 200, seed: int = 42) -> DataFrame:
    """The tests of the strongest cycles that detect found in each series (series_id, rank, method, period; the first most by rank), ordered by their score: adds method and place, the mean score of the series as overall_score, and its number of stable cycles.

    found is read several times and should be checkpointed. Cycles of one period share their tests.
    """
    some = found.where(F.col("rank") <= most).select("series_id", "period", "method", F.col("rank").alias("cycle_rank"))
    tested = some.join(stability(bars, some, column, draws, seed), ["series_id", "period"])
    order = Window.partitionBy("series_id").orderBy(F.desc("stability_score"), "cycle_rank")
    out = tested.withColumn("overall_score", F.avg("stability_score").over(whole())).withColumn("n_stable", F.count_if("is_stable").over(whole()))
    return out.withColumn("place", F.row_number().over(order))


#: MacKinnon's surface for the p-value of a unit-root statistic with a constant (range, turning point, two polynomials), and critical values of the KPSS level statistic.
UNIT_ROOT = {"least": -18.83, "most": 2.74, "turn": -1.61, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}
KPSS_LEVEL = {"statistic": (0.347, 0.463, 0.574, 0.739), "p": (0.10, 0.05, 0.025, 0.01)}


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the sum of squared residuals."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    rest = float(((y - x @ b) ** 2).sum())
    return b, np.sqrt(np.diag(inverse) * rest / max(len(y) - x.shape[1], 1)), rest


def unit_root_p(x: np.ndarray, most: int = 20) -> float:
    """p-value of the augmented Dickey-Fuller test with a constant; the number of lagged differences, up to most, has the least Akaike criterion over one sample."""
    change = np.diff(x)
    most = min(most, len(change) // 2 - 2)
    if most < 0 or not change.any():
        return 1.0

    def design(k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        lagged = [change[skip - j : len(change) - j] for j in range(1, k + 1)]
        return np.column_stack([x[skip:-1], *lagged, np.ones(len(change) - skip)]), change[skip:]

    def akaike(k: int) -> float:
        a, y = design(k, most)
        return len(y) * np.log(max(least_squares(a, y)[2], 1e-300) / len(y)) + 2 * a.shape[1]

    k = min(range(most + 1), key=akaike)
    b, error, _ = least_squares(*design(k, k))
    t = b[0] / max(error[0], 1e-300)
    if not UNIT_ROOT["least"] <= t <= UNIT_ROOT["most"]:
        return 0.0 if t < UNIT_ROOT["least"] else 1.0
    z = np.polyval(UNIT_ROOT["small" if t <= UNIT_ROOT["turn"] else "large"][::-1], t)
    return 0.5 * math.erfc(-z / math.sqrt(2))


def level_p(x: np.ndarray) -> float:
    """p-value, between 0.01 and 0.1, of the KPSS test of stationarity about a level, with lags by Hobijn, Franses and Ooms."""
    n, rest = len(x), x - x.mean()
    product = lambda k: float(rest[k:] @ rest[: n - k])
    s0, s1 = product(0) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        s0 += 2 * product(k) / n
        s1 += 2 * k * product(k) / n
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
    long_run = (product(0) + 2 * sum(product(k) * (1 - k / (lags + 1)) for k in range(1, lags + 1))) / n
    statistic = float((rest.cumsum() ** 2).sum()) / n**2 / max(long_run, 1e-300)
    return float(np.interp(statistic, KPSS_LEVEL["statistic"], KPSS_LEVEL["p"]))


def stationarity(bars: DataFrame, column: str = "close") -> DataFrame:
    """(series_id, adf_p, is_stationary_adf, kpss_p, is_stationary_kpss); series of fewer than 12 values count as not stationary."""

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        x = finite(frame[column])
        root, level = (unit_root_p(x), level_p(x)) if len(x) >= 12 and x.std() > 0 else (1.0, 0.0)
        return pd.DataFrame({"adf_p": [root], "is_stationary_adf": [root < 0.05], "kpss_p": [level], "is_stationary_kpss": [level > 0.05]})

    return per_series(bars, [column], judge, "adf_p double, is_stationary_adf boolean, kpss_p double, is_stationary_kpss boolean")
