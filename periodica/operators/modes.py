"""Empirical modes: a series as a sum of oscillations from fast to slow, by sifting with cubic-spline envelopes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from periodica.functions.series import finite, per_series


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y) with rising x, at rising places within; a line through two points."""
    h = np.diff(x)
    n = len(x)
    second = np.zeros(n)
    if n > 2:
        slope = np.diff(y) / h
        right = 6 * np.diff(slope)
        middle, upper = 2 * (h[:-1] + h[1:]), h[1:-1].copy()
        value = right.copy()
        for i in range(1, n - 2):  # elimination in a band of three
            share = h[i] / middle[i - 1]
            middle[i] -= share * upper[i - 1]
            value[i] -= share * value[i - 1]
        second[n - 2] = value[-1] / middle[-1]
        for i in range(n - 4, -1, -1):
            second[i + 1] = (value[i] - upper[i] * second[i + 2]) / middle[i]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * second[k] + (b**3 - b) * second[k + 1]) * h[k] ** 2 / 6


def turns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of local maxima and minima; of a flat top its middle."""
    keep = np.concatenate([[0], np.flatnonzero(np.diff(x) != 0) + 1])
    ends = np.append(keep[1:], len(x)) - 1
    level = np.sign(np.diff(x[keep]))
    middle = (keep + ends) // 2
    return middle[1:-1][(level[:-1] > 0) & (level[1:] < 0)], middle[1:-1][(level[:-1] < 0) & (level[1:] > 0)]


def envelope(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spline through the values at places, which are mirrored about both ends of the series."""
    last = len(x) - 1
    place = np.concatenate([-at[1::-1] if len(at) > 1 else -at, at, 2 * last - at[: -3 if len(at) > 1 else -2 : -1]])
    value = np.concatenate([x[at[1::-1]] if len(at) > 1 else x[at], x[at], x[at[: -3 if len(at) > 1 else -2 : -1]]])
    place, first = np.unique(place, return_index=True)
    return spline(place.astype(float), value[first], np.arange(len(x), dtype=float))


def sift(x: np.ndarray, most: int = 10, rounds: int = 30, still: float = 0.2) -> np.ndarray:
    """Modes as rows, from fast to slow, the rest last; their sum is x.

    A mode is what stays when the mean of the envelopes is taken off again and again, until that changes less than a share of still to the fourth of its energy (or for so many rounds); what is
    left over is sifted on, at most most times, until it has fewer than two maxima or minima or next to no energy.
    """
    rest, modes = x.astype(float).copy(), []
    energy = float(x @ x)
    while len(modes) < most:
        mode = rest.copy()
        for _ in range(rounds):
            high, low = turns(mode)
            if len(high) < 2 or len(low) < 2:
                break
            mean = (envelope(mode, high) + envelope(mode, low)) / 2
            change = float(mean @ mean) / max(float(mode @ mode), 1e-300)
            mode -= mean
            if change < still**4:
                break
        high, low = turns(rest)
        if len(high) < 2 or len(low) < 2 or float(rest @ rest) < 1e-20 * energy:
            break
        modes.append(mode)
        rest = rest - mode
    return np.array([*modes, rest])


def empirical_modes(bars: DataFrame, column: str = "close", most: int = 10) -> DataFrame:
    """(series_id, ts, mode, value, is_rest): the modes of each series of at least 4 values, from 0 (fastest) on, whose values sum to the series; the last is the rest. Gaps are left out."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[np.isfinite(frame[column].to_numpy(float, na_value=np.nan))]
        x = frame[column].to_numpy(float)
        rows = sift(x, most) if len(x) >= 4 else np.zeros((0, len(x)))
        mode = np.repeat(np.arange(len(rows)), len(x))
        return pd.DataFrame({"ts": np.tile(frame["ts"].to_numpy(), len(rows)) if len(rows) else frame["ts"].to_numpy()[:0], "mode": mode, "value": rows.reshape(-1), "is_rest": mode == len(rows) - 1})

    return per_series(bars, [column], run, "ts timestamp_ntz, mode int, value double, is_rest boolean")


def mode_cycles(bars: DataFrame, column: str = "close", most: int = 10, min_period: float = 3, max_period: float | None = None) -> DataFrame:
    """Cycles by modes: (series_id, mode, period, frequency, amplitude, power, confidence). The period is twice the mean gap of zero crossings (modes of fewer than two, and periods outside min_period to max_period or half the series, are left out); power is the share of variance, at most 1, and confidence five times that, at most 1."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, out = finite(frame[column]), []
        for i, mode in enumerate(sift(x, most) if len(x) >= 4 else ()):
            crossings = np.flatnonzero(np.diff(np.sign(mode)))
            period = 2 * float(np.diff(crossings).mean()) if len(crossings) >= 2 else 0.0
            if min_period <= period <= (max_period or len(x) // 2):
                share = min(1.0, float(mode.var() / (x.var() + 1e-10)))
                out.append((i, period, 1 / period, float(np.abs(mode).max()), share, min(1.0, 5 * share)))
        return pd.DataFrame(out, columns=["mode", "period", "frequency", "amplitude", "power", "confidence"])

    return per_series(bars, [column], run, "mode int, period double, frequency double, amplitude double, power double, confidence double")
