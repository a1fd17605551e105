"""Short-time spectra: Fourier transforms of hopping windows, their energy by band, and heatmaps of time and frequency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.functions.rolling import rolling
from periodica.functions.series import per_series, windows

#: Windows are transformed so many at once.
CHUNK = 16_384


def hopping_power(x: np.ndarray, width: int, step: int) -> np.ndarray:
    """Squared magnitudes of the spectra of x under a Hann taper, a row for each window that ends before a later value; windows begin at every step."""
    rows = windows(x[:-1], width, step) if len(x) else np.zeros((0, width))
    taper = np.hanning(width)
    parts = [np.abs(np.fft.rfft(rows[low : low + CHUNK] * taper, axis=1)) ** 2 for low in range(0, len(rows), CHUNK)]
    return np.concatenate([np.zeros((0, width // 2 + 1)), *parts])


def band_energy(bars: DataFrame, column: str = "detrended", width: int = 64, step: int = 5, over: int = 100) -> DataFrame:
    """bars (series_id, ts) with energy_short, energy_medium and energy_long: the energy in frequency bins width/8 to width/4, width/4 to width/2 and from width/2 of the width values
    before a bar, at every step-th bar from the width-th and 0 at all others, over the largest of the last over bars; null until there are so many. Gaps count as 0."""
    bands = {"short": (width // 8, width // 4), "medium": (width // 4, width // 2), "long": (width // 2, width)}

    def energies(frame: pd.DataFrame) -> pd.DataFrame:
        power = hopping_power(frame[column].fillna(0.0).to_numpy(float), width, step)
        out = {"ts": frame["ts"]}
        for name, (low, high) in bands.items():
            values = np.zeros(len(frame))
            values[width + step * np.arange(len(power))] = power[:, low:high].sum(axis=1)
            out[f"_{name}"] = values
        return pd.DataFrame(out)

    rows = per_series(bars, [column], energies, "ts timestamp_ntz, " + ", ".join(f"_{b} double" for b in bands))
    return rows.select("series_id", "ts", *[(F.col(f"_{b}") / (rolling(f"_{b}", over, F.max) + 1e-10)).alias(f"energy_{b}") for b in bands])


def spectrogram(bars: DataFrame, column: str = "detrended", width: int = 64, step: int = 16) -> DataFrame:
    """A heatmap: (series_id, window, ts, k, period, frequency, power) for every hopping window and frequency k / width but 0; ts is that of the window's last bar, power is relative to the largest of the series. Gaps count as 0."""

    def heat(frame: pd.DataFrame) -> pd.DataFrame:
        power = hopping_power(np.append(frame[column].fillna(0.0).to_numpy(float), 0.0), width, step)[:, 1:]
        power = power / max(power.max(initial=0.0), 1e-300)
        window, k = np.divmod(np.arange(power.size), max(power.shape[1], 1))
        end = frame["ts"].to_numpy()[window * step + width - 1] if power.size else frame["ts"].to_numpy()[:0]
        return pd.DataFrame({"window": window, "ts": end, "k": k + 1, "period": width / (k + 1), "frequency": (k + 1) / width, "power": power.reshape(-1)})

    return per_series(bars, [column], heat, "window int, ts timestamp_ntz, k int, period double, frequency double, power double")
