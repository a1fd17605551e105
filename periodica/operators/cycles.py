"""The cycle engine: candidates of several spectral methods, their strength and rank, consensus among methods, turning points."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.series import find_peaks, finite, per_series
from periodica.operators import spectral

LEAST_BARS = 32
LEAST_POWER = 0.01
CANDIDATE = "method string, period double, frequency double, amplitude double, power double, phase double, confidence double, n long, place int"
Found = Iterable[tuple[float, float, float, float, float, float]]


def by_fourier(x: np.ndarray, low: float, high: float) -> Found:
    """Peaks of the Hann-tapered power spectrum."""
    n = len(x)
    waves, frequency = np.fft.rfft(x * np.hanning(n)), np.fft.rfftfreq(n)
    power = np.abs(waves) ** 2 / max((np.abs(waves) ** 2).max(), 1e-300)
    inside = np.flatnonzero((frequency > 1 / high) & (frequency < 1 / low))
    for i in inside[find_peaks(power[inside], LEAST_POWER, 2, 0.005)]:
        yield 1 / frequency[i], frequency[i], 2 * np.sqrt(power[i]) / n, power[i], np.angle(waves[i]), 0.0


def by_lomb_scargle(x: np.ndarray, low: float, high: float) -> Found:
    """Peaks of the generalised Lomb-Scargle periodogram above the 5 % false-alarm level (Baluev, 2008)."""
    n, t = len(x), np.arange(len(x), dtype=float)
    grid = np.linspace(1 / high, 1 / low, min(2000, 10 * n))
    y = (x - x.mean()) / (x.std() + 1e-10)
    power = np.zeros(len(grid))
    for at in range(0, len(grid), 256):
        angle = 2 * np.pi * grid[at : at + 256, None] * t
        c, s = np.cos(angle), np.sin(angle)
        c, s = c - c.mean(axis=1, keepdims=True), s - s.mean(axis=1, keepdims=True)
        yc, ys, cc, ss, cs = c @ y, s @ y, (c * c).sum(axis=1), (s * s).sum(axis=1), (c * s).sum(axis=1)
        power[at : at + 256] = (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / np.maximum(cc * ss - cs**2, 1e-12) / (y @ y)
    width = grid[-1] * np.sqrt(4 * np.pi * t.var())

    def alarm(z: np.ndarray) -> np.ndarray:
        single = (1 - z) ** ((n - 3) / 2)
        extreme = width * (1 - z) ** ((n - 4) / 2) * np.sqrt(np.maximum(0.5 * (n - 1) * z, 0))
        return 1 - (1 - single) * np.exp(-extreme)

    levels = np.linspace(0, 1, 20_001)
    least = levels[np.argmax(alarm(levels) <= 0.05)]
    for i in find_peaks(power, least, 3, 0.02):
        yield 1 / grid[i], grid[i], np.sqrt(power[i]), power[i] / power.max(), 0.0, float(np.clip(1 - alarm(power[i]), 0, 1))


def by_wavelet(x: np.ndarray, low: float, high: float) -> Found:
    """Peaks over scales of the mean power of a real Morlet wavelet (centre frequency 0.8125)."""
    scales = np.arange(low, min(high, len(x) // 2))
    if not len(scales):
        return
    size = 1 << int(np.ceil(np.log2(len(x) + 16 * scales[-1] + 1)))
    spectrum = np.fft.rfft(x, size)
    means, phases = [], []
    for scale in scales:
        t = np.arange(-8 * scale, 8 * scale + 1) / scale
        wavelet = np.exp(-t * t / 2) * np.cos(5 * t) / np.sqrt(scale)
        convolved = np.fft.irfft(spectrum * np.fft.rfft(wavelet, size), size)[len(t) // 2 :][: len(x)]
        means.append((convolved**2).mean())
        phases.append(np.where(convolved < 0, np.pi, 0.0).mean())
    mean = np.array(means)
    power = mean / max(mean.max(), 1e-300)
    for i in find_peaks(power, LEAST_POWER, 2, 0.01):
        yield scales[i] / 0.8125, 0.8125 / scales[i], np.sqrt(mean[i]), power[i], phases[i], 0.0


def by_autocorrelation(x: np.ndarray, low: float, high: float) -> Found:
    """Peaks of the autocorrelation over 1.5 bounds of noise."""
    n, low = len(x), int(low)
    waves = np.fft.rfft(x - x.mean(), 1 << (2 * n - 1).bit_length())
    curve = np.fft.irfft(np.abs(waves) ** 2)[:n]
    curve = curve / max(curve[0], 1e-300)
    bound = 1.96 / np.sqrt(n)
    for i in find_peaks(curve[low : int(min(high, n // 2))], 1.5 * bound, max(1, low // 2), 0.05) + low:
        yield float(i), 1 / i, curve[i], float(np.clip(curve[i], 0, 1)), 0.0, min(1.0, curve[i] / bound)


def by_welch(x: np.ndarray, low: float, high: float) -> Found:
    """Peaks of the mean power of half-overlapping, mean-removed, Hann-tapered segments."""
    length = min(256, len(x) // 2)
    parts = np.lib.stride_tricks.sliding_window_view(x, length)[:: length - length // 2]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    power = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * taper)) ** 2).mean(axis=0) / (taper @ taper)
    power[1 : (length + 1) // 2] *= 2
    frequency = np.fft.rfftfreq(length)
    inside = np.flatnonzero((frequency > 0) & (frequency >= 1 / high) & (frequency <= 1 / low))
    if not len(inside):
        return
    share = power[inside] / max(power[inside].max(), 1e-300)
    for k in find_peaks(share, LEAST_POWER, 2, 0.01):
        yield 1 / frequency[inside[k]], frequency[inside[k]], np.sqrt(power[inside[k]]), share[k], 0.0, 0.0


def by_hilbert(x: np.ndarray, low: float, high: float) -> Found:
    """Peaks of the histogram of instantaneous frequencies of the analytic signal."""
    n = len(x)
    waves = np.fft.fft(x)
    waves[1 : (n + 1) // 2] *= 2
    waves[n // 2 + 1 :] = 0
    analytic = np.fft.ifft(waves)
    phase = np.unwrap(np.angle(analytic))
    frequency = np.diff(phase) / (2 * np.pi)
    frequency = frequency[(frequency > 1 / high) & (frequency < 1 / low)]
    if not len(frequency):
        return
    counts, edges = np.histogram(frequency, 200)
    share, middle = counts / counts.max(), (edges[1:] + edges[:-1]) / 2
    for i in find_peaks(share, 0.1, 2, 0.05):
        yield 1 / middle[i], middle[i], np.abs(analytic).mean(), share[i], phase[-1] % (2 * np.pi), 0.0


METHODS: dict[str, Callable[[np.ndarray, float, float], Found]] = {
    "fft": by_fourier, "lomb_scargle": by_lomb_scargle, "wavelet": by_wavelet, "autocorrelation": by_autocorrelation, "spectral_density": by_welch, "hilbert": by_hilbert,
}


def candidates(bars: DataFrame, column: str, methods: tuple[str, ...] = tuple(METHODS), min_period: int = 3, max_period: int | None = None, top: int = 20) -> DataFrame:
    """(series_id, method, period, frequency, amplitude, power, phase, confidence, n, place) of the top peaks of each method; place orders methods and, within each, power. Gaps are left out; series of fewer than 32 values give none."""

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        x, rows = finite(frame[column]), []
        for method in methods if len(x) >= LEAST_BARS else ():
            found = [r for r in METHODS[method](x, min_period, max_period or len(x) // 2) if min_period <= r[0] <= (max_period or len(x) // 2) or method in ("wavelet", "spectral_density")]
            rows += [(method, *map(float, r), len(x)) for r in sorted(found, key=lambda r: -r[3])[:top]]
        names = [c.split()[0] for c in CANDIDATE.split(", ")]
        return pd.DataFrame([(*r, i) for i, r in enumerate(rows)], columns=names)

    return per_series(bars, [column], find, CANDIDATE)


def detect(bars: DataFrame, column: str, top: int = 20, bars_per_day: float = 1.0, **how: object) -> DataFrame:
    """The dominant cycles of each series over all methods: candidates by strength, with calendar periods and, for the first ten, the next turning point."""
    ranked = spectral.score(candidates(bars, column, top=top, **how), top)
    turned = spectral.turning_points(ranked.withColumn("period_calendar", F.col("period") / bars_per_day))
    first = F.col("rank") <= 10
    return turned.withColumns({c: F.when(first, F.col(c)) for c in ("next_turning_point_bars", "turning_point_type")})


def consensus(found: DataFrame, per_method: int = 5, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Cycles that at least two candidates agree on: the first per_method of each method, in order, join the first earlier period they lie within low to high of; means of each group.

    found has candidates with strength. Groups are at most methods times per_method rows a series.
    """
    some = found.withColumn("_k", F.row_number().over(Window.partitionBy("series_id", "method").orderBy("place"))).where(F.col("_k") <= per_method)

    def grouped(frame: pd.DataFrame) -> pd.DataFrame:
        heads: list[float] = []
        group = []
        for period in (frame := frame.sort_values("place"))["period"]:
            at = next((i for i, h in enumerate(heads) if low <= period / h <= high), len(heads))
            if at == len(heads):
                heads.append(period)
            group.append(at)
        return frame.assign(group=group)[["series_id", "group", "method", "period", "amplitude", "power", "phase", "confidence", "strength"]]

    rows = some.select("series_id", "place", "method", "period", "amplitude", "power", "phase", "confidence", "strength").groupBy("series_id").applyInPandas(grouped, "series_id string, group int, method string, period double, amplitude double, power double, phase double, confidence double, strength double")
    n = F.count("*")
    out = rows.groupBy("series_id", "group").agg(
        F.concat(F.lit("consensus["), F.array_join(F.array_sort(F.collect_set("method")), ","), F.lit("]")).alias("method"), F.avg("period").alias("period"), F.avg("amplitude").alias("amplitude"), F.avg("power").alias("power"),
        F.avg("phase").alias("phase"), F.avg("confidence").alias("confidence"), F.least(F.max("strength") * (1 + 0.1 * (n - 1)), F.lit(1.0)).alias("strength"), n.alias("n_found"),
    )
    return out.where("n_found >= 2").withColumn("frequency", 1 / F.col("period")).drop("group")


def hurst(bars: DataFrame, column: str) -> DataFrame:
    """Hurst exponent by rescaled range over every lag from 10 to min(n / 4, 200): slope of the logarithm of the mean range over deviation of chunks; 0.5 for fewer than 20 values or 5 lags, held to 0..1."""

    def slope(frame: pd.DataFrame) -> pd.DataFrame:
        x, lags, means = finite(frame[column]), [], []
        n = len(x)
        for lag in range(10, min(n // 4, 200)) if n >= 20 else ():
            parts = x[: len(range(0, n - lag, lag)) * lag].reshape(-1, lag)
            walk = (parts - parts.mean(axis=1, keepdims=True)).cumsum(axis=1)
            reach, deviation = walk.max(axis=1) - walk.min(axis=1), parts.std(axis=1, ddof=1)
            if (deviation > 0).any():
                mean = (reach[deviation > 0] / deviation[deviation > 0]).mean()
                if mean > 0:
                    lags.append(lag)
                    means.append(mean)
        value = np.polyfit(np.log(lags), np.log(means), 1)[0] if len(lags) >= 5 else 0.5
        return pd.DataFrame({"hurst": [float(np.clip(value, 0, 1))]})

    return per_series(bars, [column], slope, "hurst double")
