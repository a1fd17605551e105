"""Modes sum to the series, and planted tones come apart."""

import numpy as np
from pyspark.sql import functions as F

from periodica.operators import modes


def test_spline_goes_through_its_points_and_solves_its_equations():
    random = np.random.default_rng(1)
    for n in (2, 3, 4, 9, 40):
        x = np.sort(random.choice(500, n, replace=False)).astype(float)
        y = random.normal(size=n)
        assert np.allclose(modes.spline(x, y, x), y)
        if n > 2:
            h = np.diff(x)
            full = np.zeros((n, n))
            full[0, 0] = full[-1, -1] = 1
            for i in range(1, n - 1):
                full[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            second = np.linalg.solve(full, np.concatenate([[0], 6 * np.diff(np.diff(y) / h), [0]]))
            at = (x[:-1] + x[1:]) / 2
            assert np.allclose(modes.spline(x, y, at), (y[:-1] + y[1:]) / 2 - (second[:-1] + second[1:]) * h**2 / 16)


def test_turns_take_the_middle_of_flat_tops():
    high, low = modes.turns(np.array([0, 1, 1, 1, 0, -1, 0, 0.0]))
    assert high.tolist() == [2] and low.tolist() == [5]


def test_two_tones_come_apart_and_modes_sum_up(spark):
    t = np.arange(800)
    fast, slow = np.sin(2 * np.pi * t / 12), 2 * np.sin(2 * np.pi * t / 90)
    rows = [("s", i, float(a)) for i, a in enumerate(fast + slow + 0.002 * t)] + [("line", i, float(i)) for i in range(30)] + [("gap", i, None) for i in range(10)] + [("flat", i, 1.0) for i in range(10)]
    frame = spark.createDataFrame(rows, "series_id string, i int, close double").select("series_id", F.timestamp_add("DAY", F.col("i"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ts"), "close")
    out = modes.empirical_modes(frame).join(frame, ["series_id", "ts"])
    sums = out.groupBy("series_id", "ts").agg(F.sum("value").alias("v"), F.first("close").alias("c")).collect()
    assert len(sums) == 840 and all(abs(r.v - r.c) < 1e-9 for r in sums)
    inner = slice(60, -60)
    by_mode = {m: np.array([r.value for r in out.where(f"series_id = 's' and mode = {m}").orderBy("ts").collect()]) for m in (0, 1)}
    assert np.corrcoef(by_mode[0][inner], fast[inner])[0, 1] > 0.99 and np.corrcoef(by_mode[1][inner], slow[inner])[0, 1] > 0.99
    found = {r.mode: r for r in modes.mode_cycles(frame).where("series_id = 's'").collect()}
    assert abs(found[0].period - 12) < 0.5 and abs(found[1].period - 90) < 6 and found[1].power > found[0].power
    assert modes.mode_cycles(frame.where("series_id in ('line', 'gap', 'flat')")).count() == 0
