import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.functions.series import dtw, find_peaks, prominences
from periodica.operators import cleaning, cycles, joins, patterns, relations, spectral, stability

START = datetime.datetime(2020, 1, 1)


def series(spark, values, name="a"):
    rows = [(name, START + datetime.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double")


def test_peaks_follow_their_rules():
    x = np.array([0, 2, 1, 3, 3, 3, 0, 1, 0.5, 5, 0])
    assert find_peaks(x).tolist() == [1, 4, 7, 9]
    assert find_peaks(x, height=2.5).tolist() == [4, 9]
    assert find_peaks(x, distance=3).tolist() == [1, 4, 9]
    assert prominences(x, np.array([1, 4, 7, 9])).tolist() == [1, 3, 0.5, 5]
    assert find_peaks(x, prominence=1).tolist() == [1, 4, 9] and find_peaks(np.zeros(2)).tolist() == []


def test_hp_trend_solves_its_equations():
    x = np.random.default_rng(1).standard_normal(60).cumsum()
    for n in (1, 2, 3, 5, 60):
        d = np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
        assert np.allclose(cleaning.hp_trend(x[:n], 1600.0), np.linalg.solve(np.eye(n) + 1600 * d.T @ d, x[:n]))


def test_time_warping_equals_the_plain_table():
    random = np.random.default_rng(2)
    a, b = random.standard_normal(9), random.standard_normal((4, 9))
    for row, found in zip(b, dtw(a, b), strict=True):
        t = np.full((10, 10), np.inf)
        t[0, 0] = 0
        for i in range(9):
            for j in range(9):
                t[i + 1, j + 1] = (a[i] - row[j]) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
        assert math.isclose(found, math.sqrt(t[9, 9]))


def test_cycles_are_found_and_agreed_on(spark):
    t = np.arange(600)
    bars = series(spark, 3 * np.sin(2 * np.pi * t / 60) + 2 * np.sin(2 * np.pi * t / 20) + 0.3 * np.random.default_rng(3).standard_normal(600)).unionByName(series(spark, range(10), "short"))
    found = cycles.detect(bars, "close").collect()
    assert {r.series_id for r in found} == {"a"} and [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, len(found) + 1))
    for method in ("fft", "lomb_scargle", "wavelet", "autocorrelation"):
        assert any(abs(r.period - p) < 0.2 * p for r in found if r.method == method for p in (20, 60)), method
    agreed = cycles.consensus(spectral.score(cycles.candidates(bars, "close"), 1000)).collect()
    assert any(abs(r.period - 60) < 12 and r.n_found >= 2 for r in agreed)


def test_walk_forward_equals_plain_loops(spark):
    x = 50 + np.sin(2 * np.pi * np.arange(500) / 20) * np.linspace(1, 0.1, 500) + 0.2 * np.random.default_rng(4).standard_normal(500)
    x = x - x.mean()
    bars = series(spark, x)
    wanted = bars.select("series_id").distinct().withColumn("period", F.lit(20.0))
    row = stability.walk_forward(bars, wanted).first()
    powers = np.array([stability.share_at(x[s : s + 100][None], 20.0)[0] for s in range(0, 400, 25)])
    hit = powers[powers > 0.01]
    slope, base = np.polyfit(np.arange(len(powers)), powers, 1)
    assert row.n_windows == 16 and math.isclose(row.detection_rate, len(hit) / 16) and math.isclose(row.power_mean, hit.mean(), rel_tol=1e-6) and math.isclose(row.power_std, hit.std(), rel_tol=1e-6)
    assert math.isclose(row.decay_per_year, -slope * 252 / 25, rel_tol=1e-6) and row.half_life_bars == int(base / (2 * abs(slope)) * 25)
    tested = stability.surrogates(bars, wanted, draws=40).first()
    assert 0 <= tested.percentile <= 1 and tested.is_significant == (tested.percentile > 0.95)  # surrogates keep the spectrum
    assert stability.surrogates(bars, wanted, draws=40).first() == tested


def test_analogs_look_back_only(spark):
    random = np.random.default_rng(5)
    x = 100 + random.standard_normal(400).cumsum() * 0.5
    x[340:400] = x[100:160] - x[100] + x[339]
    found = relations.historical_analogs(series(spark, x), lookback=40, method="euclidean", top=5).collect()
    z = lambda v: (v - v.mean()) / v.std()
    apart = {s: np.linalg.norm(z(x[359:]) - z(x[s : s + 41])) for s in range(359 - 40 - 30)}
    want = []
    for s in sorted(apart, key=apart.get):
        if all(abs(s - u) >= 30 for u in want):
            want.append(s)
    assert [r.start_bar for r in found] == want[:5] and all(math.isclose(r.distance, apart[r.start_bar], abs_tol=1e-9) for r in found)
    assert all(r.end_bar <= 359 - 30 for r in found) and len(relations.analog_projection(spark.createDataFrame(found)).collect()) == 1


def test_motifs_and_regimes(spark):
    random = np.random.default_rng(6)
    x = random.standard_normal(200) + 10
    x[150:160] = 3 * x[20:30] + 1
    first = patterns.motifs(series(spark, x)).orderBy("rank").first()
    assert {first.start_a, first.start_b} == {20, 150} and first.distance < 1e-5
    steps = np.concatenate([0.001 * random.standard_normal(150), 0.05 * random.standard_normal(150)])
    states = {r.bar: r.state for r in patterns.regimes(series(spark, 100 * np.exp(steps.cumsum())), states=2).collect()}
    calm, wild = [states[i] for i in range(40, 140)], [states[i] for i in range(200, 290)]
    assert np.mean(calm) < 0.2 and np.mean(wild) > 0.8 or np.mean(calm) > 0.8 and np.mean(wild) < 0.2


def test_stationarity_tells_noise_from_walks(spark):
    random = np.random.default_rng(7)
    noise, walk = random.standard_normal(500), (random.standard_normal(500) + 0.2).cumsum()
    rows = {r.series_id: r for r in stability.stationarity(series(spark, noise, "noise").union(series(spark, walk, "walk")).union(series(spark, [1.0] * 5, "short"))).collect()}
    assert rows["noise"].is_stationary_adf and rows["noise"].is_stationary_kpss and not rows["walk"].is_stationary_adf and not rows["walk"].is_stationary_kpss and not rows["short"].is_stationary_adf


def test_first_source_with_bars_counts(spark):
    bars = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("c", 4, "x"), ("c", 5, "w")], "series_id string, close int, source string")
    assert sorted(r.close for r in joins.first_available(bars, "source", ["y", "x"]).collect()) == [2, 3, 4]


def test_averages_begin_after_gaps(spark):
    from periodica.operators import features

    rows = features.macd(series(spark, [None, 1.0, 2.0, None, 3.0])).orderBy("ts").collect()
    assert len(rows) == 5 and rows[1].macd == 0.0


def test_motifs_by_tiles_equal_one_block(spark):
    random = np.random.default_rng(6)
    x = random.standard_normal(230).cumsum()
    x[40:60] = x[40]
    x[150:162] = x[20:32]
    x[200:215] = 1.0
    bars = series(spark, x, "a").union(series(spark, random.standard_normal(90), "b")).union(series(spark, [1.0] * 30, "short"))
    whole, tiled = patterns.nearest_windows(bars), patterns.nearest_windows(bars.repartition(3), block=32)
    key = ["series_id", "start"]
    one, many = whole.orderBy(key).collect(), tiled.orderBy(key).collect()
    assert [(r.series_id, r.start) for r in one] == [(r.series_id, r.start) for r in many] and len(one) == 221 + 81
    assert np.allclose([r.distance for r in one], [r.distance for r in many], atol=1e-6)
    shapes = np.array([x[i : i + 10] for i in range(221)])
    flat = shapes.std(axis=1) < 1e-8
    shapes = (shapes - shapes.mean(axis=1)[:, None]) / np.where(flat, 1, shapes.std(axis=1))[:, None]
    apart = np.sqrt(((shapes[:, None] - shapes[None]) ** 2).sum(axis=2))
    apart[flat[:, None] & flat[None, :]] = 0
    apart[np.abs(np.arange(221)[:, None] - np.arange(221)) <= 3] = np.inf
    assert np.allclose([r.distance for r in many if r.series_id == "a"], apart.min(axis=1), atol=1e-6)
    assert patterns.motifs(bars, block=32).where("series_id = 'a' and rank = 1").first().distance < 1e-6


def test_walk_forward_of_long_cycles(spark):
    x = np.sin(2 * np.pi * np.arange(600) / 150) + np.arange(600) / 600
    bars = series(spark, x).union(series(spark, x[:40], "short"))
    wanted = spark.createDataFrame([("a", 150.0), ("a", 1.5), ("short", 10.0)], "series_id string, period double")
    rows = {(r.series_id, r.period): r for r in stability.walk_forward(bars, wanted).collect()}
    powers = [stability.share_at(x[s : s + 120][None], 150.0)[0] for s in range(0, 480, 30)]
    slope = np.polyfit(np.arange(16), powers, 1)[0]
    long = rows[("a", 150.0)]
    assert (long.detection_rate, long.period_cv, long.n_windows, long.power_mean) == (0, 1, 16, 0)
    assert long.decay_per_year == pytest.approx(-slope * 252 / 30, abs=1e-9) and long.decay_per_year != 0
    assert (rows[("a", 1.5)].detection_rate, rows[("a", 1.5)].decay_per_year, rows[("short", 10.0)].n_windows, rows[("short", 10.0)].decay_per_year) == (0, 0, 1, 0)


def test_stability_of_detected_cycles(spark):
    x = np.sin(2 * np.pi * np.arange(400) / 20) + 0.3 * np.random.default_rng(5).standard_normal(400)
    bars = series(spark, x)
    found = cycles.detect(bars, "close").cache()
    rows = stability.detected_stability(bars, found, most=6, draws=30).orderBy("place").collect()
    assert len(rows) == found.where("rank <= 6").count()
    scores = [r.stability_score for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert all(r.overall_score == pytest.approx(np.mean(scores)) and r.n_stable == sum(s >= 0.5 for s in scores) for r in rows)
    near = next(r for r in rows if abs(r.period - 20) < 2)
    assert near.is_stable and near.place == 1
