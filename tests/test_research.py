"""Operators of short-time spectra, the sky, lead and lag, mutual information and warping clusters, held against published values and plain computations."""

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.functions.statistics import correlation_p, ln_gamma
from periodica.operators import ephemeris, information, relations, spectrogram, warping

#: Published geocentric longitudes at noon of 2000-01-01, and others by date: (ts, body, longitude).
PUBLISHED = [
    *[("2000-01-01 12:00:00", b, x) for b, x in {"sun": 280.37, "moon": 223.32, "mercury": 271.89, "venus": 241.57, "mars": 327.96, "jupiter": 25.25, "saturn": 40.40, "uranus": 314.81, "neptune": 303.19, "pluto": 251.45}.items()],
    ("1992-12-20 00:00:00", "venus", 313.08), ("1992-04-12 00:00:00", "moon", 133.16), ("1992-10-13 00:00:00", "sun", 199.91),
]


def days(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))


def bars(spark, series):
    rows = [(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id string, i int, close double").select("series_id", F.timestamp_add("DAY", F.col("i"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("ts"), "close")


def test_positions_are_the_published_ones(spark):
    got = {(str(r.ts), r.body): r for r in ephemeris.positions(days(spark, *{t for t, *_ in PUBLISHED})).collect()}
    assert len(got) == 10 * len({t for t, *_ in PUBLISHED})
    assert all(abs((got[t, b].lon - x + 180) % 360 - 180) < (0.2 if b in ("jupiter", "saturn") else 0.1) for t, b, x in PUBLISHED)
    assert abs(math.degrees(got["1992-10-13 00:00:00", "sun"].dec) + 7.785) < 0.01 and got["2000-01-01 12:00:00", "saturn"].retrograde
    sun = got["2000-01-01 12:00:00", "sun"]
    assert abs((sun.lon - sun.helio_lon) % 360 - 180) < 1e-6 and not any(r.helio_speed < 0 for r in got.values())


def test_aspects_become_exact_at_known_moons(spark):
    march = days(spark, *[f"2024-03-{d:02d} 00:00:00" for d in range(1, 31)])
    found = ephemeris.exact_aspects(march)
    moons = {r.aspect: str(r.exact_ts) for r in found.where("body_a = 'sun' and body_b = 'moon' and aspect in ('conjunction', 'opposition')").collect()}
    assert moons["conjunction"].startswith("2024-03-10 09:0") and moons["opposition"].startswith("2024-03-25 07:0")
    rows = found.collect()
    assert all(r.error < 1e-5 for r in rows) and len({(r.ts, r.body_a, r.body_b, r.aspect) for r in rows}) == len(rows)
    then = ephemeris.aspects(found.select(F.col("exact_ts").alias("ts")).distinct()).select("ts", "body_a", "body_b", "aspect", "proximity")
    met = found.withColumnRenamed("ts", "day").withColumnRenamed("exact_ts", "ts").join(then, ["ts", "body_a", "body_b", "aspect"]).collect()
    assert len(met) == len(rows) and all(r.proximity < 3e-4 for r in met)
    daily = {(r.ts, r.body_a, r.body_b): r.angle for r in ephemeris.aspects(march).collect()}
    crossed = {k for k in daily if (n := (k[0] + timedelta(days=1), *k[1:])) in daily and (daily[k] - 90) * (daily[n] - 90) < 0}
    assert crossed <= {(r.ts, r.body_a, r.body_b) for r in rows if r.aspect == "square"}
    assert ephemeris.exact_aspects(march.where("false")).count() == 0


def test_upcoming_are_the_first_within_the_orb(spark):
    rows = ephemeris.upcoming(days(spark, "2024-03-01 00:00:00")).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 50 and all(r.orb <= 1 and 0 <= r.days_from_now < 30 for r in rows)
    assert [r.days_from_now for r in rows] == sorted(r.days_from_now for r in rows)


def test_tails_of_correlations(spark):
    known = [(0.1, 100, 0.32221737), (0.5, 20, 0.02476956), (-0.9, 10, 0.00038716), (0.0, 5, 1.0), (1.0, 5, 0.0), (0.5, 3, 2 / 3), (0.3, 4, 0.7)]  # at 2 degrees of freedom p is 1 - |r|
    got = spark.createDataFrame([k[:2] for k in known] + [(None, 9), (0.5, 2)], "r double, n int").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert all(abs(r.p - k[2]) < 1e-7 for r, k in zip(got, known)) and got[-1].p is None and got[-2].p is None
    gammas = spark.createDataFrame([(z,) for z in (0.5, 1.0, 2.5, 40.0, 5e4)], "z double").select("z", ln_gamma(F.col("z")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(r.z)) < 1e-10 * max(1, abs(r.g)) for r in gammas)


def test_lead_lag_finds_the_planted_lead(spark):
    random = np.random.default_rng(3)
    y, x = random.normal(size=400), np.round(random.normal(size=400), 1)
    y[7:] += 2 * x[:-7]
    y[50] = np.nan
    features = spark.createDataFrame([("s", f, i, None if f == "x" and i == 9 else float(v)) for f, values in (("x", x), ("flat", np.zeros(400))) for i, v in enumerate(values)], "series_id string, feature string, bar int, value double")
    target = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series_id string, bar int, value double")
    got = {(r.feature, r.lag): r for r in relations.lead_lag(features, target, most=10).collect()}
    assert len(got) == 42 and max((k for k in got if k[0] == "x"), key=lambda k: abs(got[k].pearson_r)) == ("x", 7)

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    for lag in (-10, 0, 7):
        pairs = np.array([(x[i], y[i + lag]) for i in range(400) if i != 9 and 0 <= i + lag < 400 and np.isfinite(y[i + lag])]).T
        r = got["x", lag]
        assert r.n == pairs.shape[1] and abs(r.pearson_r - np.corrcoef(pairs)[0, 1]) < 1e-9 and abs(r.spearman_r - np.corrcoef(ranks(pairs[0]), ranks(pairs[1]))[0, 1]) < 1e-9
    assert got["x", 7].pearson_p < 1e-12 and got["flat", 0].pearson_r is None and got["flat", 0].pearson_p is None
    assert relations.lead_lag(features.where("false"), target).count() == 0


def all_pairs(x, y, k):
    """Mutual information by the full table of distances."""
    x, y = x / x.std(), y / y.std()
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    far = np.maximum(dx, dy)
    np.fill_diagonal(far, np.inf)
    r = np.nextafter(np.sort(far, axis=1)[:, k - 1], 0)[:, None]
    psi = lambda n: np.array([sum(1 / i for i in range(1, v)) - np.euler_gamma for v in np.atleast_1d(n)])
    return max(0.0, float(psi(len(x))[0] + psi(k)[0] - psi((dx <= r).sum(axis=1)).mean() - psi((dy <= r).sum(axis=1)).mean()))


@pytest.mark.parametrize("seed", range(6))
def test_neighbour_information_equals_all_pairs(seed):
    random = np.random.default_rng(seed)
    x, y = random.normal(size=300), random.normal(size=300)
    if seed % 3 == 1:
        x, y = np.round(x, 1), np.round(y + x, 1)  # many ties
    if seed % 3 == 2:
        x, y = np.exp(3 * x), x * x + 0.1 * y
    assert abs(information.kraskov(x, y, 3) - all_pairs(x, y, 3)) < 1e-9


def test_mutual_information_by_feature(spark):
    random = np.random.default_rng(1)
    x, noise = random.normal(size=500), random.normal(size=500)
    rows = [("s", float(a), float(b), 1.0, float(a * a)) for a, b in zip(x, noise)] + [("t", 1.0, None, 1.0, 2.0)]
    got = {(r.series_id, r.feature): r for r in information.mutual_information(spark.createDataFrame(rows, "series_id string, x double, noise double, flat double, target double"), ["x", "noise", "flat"]).collect()}
    assert got["s", "x"].mi_score > 0.99 and got["s", "noise"].mutual_info < 0.1 and got["s", "flat"].mutual_info == 0 and got["t", "noise"].n == 0


def test_spectrogram_shows_a_change_of_period(spark):
    t = np.arange(1000)
    x = np.where(t < 500, np.sin(2 * np.pi * t / 8), np.sin(2 * np.pi * t / 16))
    rows = spectrogram.spectrogram(bars(spark, {"s": x, "short": x[:50]}), "close").collect()
    best = {}
    for r in rows:
        if r.window not in best or r.power > best[r.window].power:
            best[r.window] = r
    assert {r.series_id for r in rows} == {"s"} and len(best) == (1000 - 64) // 16 + 1
    assert best[0].k == 8 and best[max(best)].k == 4 and max(r.power for r in rows) == 1
    energy = spectrogram.band_energy(bars(spark, {"s": x, "short": x[:50]}), "close").orderBy("series_id", "ts").collect()
    assert len(energy) == 1050 and energy[98].energy_short is None and energy[99].energy_short is not None
    assert energy[164].energy_short > 0.9 and energy[165].energy_short == 0  # every fifth bar only


def plain_linkage(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: max(d[u, v] for u in groups[p[0]] for v in groups[p[1]]))
        groups[b] += groups.pop(a)
    label = np.zeros(len(d), int)
    for g in groups:
        label[g] = min(g)
    return np.unique(label, return_inverse=True)[1]


def plain_warping(a, b):
    table = np.full((len(a) + 1, len(b) + 1), np.inf)
    table[0, 0] = 0
    for i, u in enumerate(a):
        for j, v in enumerate(b):
            table[i + 1, j + 1] = (u - v) ** 2 + min(table[i, j], table[i, j + 1], table[i + 1, j])
    return math.sqrt(table[-1, -1])


def test_linkage_by_chains_equals_plain_linkage():
    random = np.random.default_rng(2)
    for n, k in ((1, 1), (2, 1), (12, 3), (30, 5), (30, 40)):
        x = random.normal(size=(n, 3))
        d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
        assert (warping.complete_linkage(d, k) == plain_linkage(d, k)).all()


def test_warped_clusters_equal_plain_ones(spark, monkeypatch):
    random = np.random.default_rng(4)
    shapes = [np.roll(np.sin(np.linspace(0, f * np.pi, 16)), random.integers(3)) + 0.05 * random.normal(size=16) for f in (2, 2, 4, 6) for _ in range(35)]
    rows = [("a", i, i + 16, [float(v) for v in w]) for i, w in enumerate(shapes)] + [("b", i, i + 16, [float(v) for v in w]) for i, w in enumerate(shapes[:4])]
    frame = spark.createDataFrame(rows, "series_id string, start_bar long, end_bar long, window array<double>").repartition(3)
    d = np.array([[plain_warping(a, b) for b in shapes] for a in shapes])
    apart = {(r.place, o): v for r in warping.warped_distances(frame.where("series_id = 'a'").withColumn("place", F.col("start_bar").cast("int"))).collect() for o, v in zip(r.others, r.distances)}
    assert all(abs(v - d[i, j]) < 1e-9 for (i, j), v in apart.items()) and {tuple(sorted(k)) for k in apart} == {(i, j) for j in range(len(d)) for i in range(j + 1)}
    got = {r.start_bar: r.cluster for r in warping.warped_clusters(frame, k=4).collect()}
    want = plain_linkage(d, 4)
    assert got == {i: c for i, c in enumerate(want) if (want == c).sum() >= 3}
    assert {r.series_id for r in warping.warped_clusters(frame, most=100).collect()} == {"a"}  # by k-means
