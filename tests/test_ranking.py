import datetime

import numpy as np
import pytest

from periodica.operators import features, information, models, ranking, relations

NAMES = ["good", "cat_kind_noise", "cat_kind_flat"]


@pytest.fixture(scope="module")
def matrix(spark):
    random, rows = np.random.default_rng(4), []
    for s in ("a", "b"):
        for i in range(300):
            good = random.standard_normal()
            aim = None if i >= 295 else good + (0.2 if s == "a" else 2.0) * random.standard_normal()
            rows.append((s, datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i), good, random.standard_normal(), 1.0, aim))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, good double, cat_kind_noise double, cat_kind_flat double, target double").cache()


def test_composite_scores_follow_their_parts(spark, matrix):
    got = {(r.series_id, r.feature): r for r in ranking.ranked(matrix, NAMES).collect()}
    known = matrix.where("target is not null")
    forest = dict(models.forest_importance(known, NAMES).collect())
    assert sum(forest.values()) == pytest.approx(1) and forest["good"] > 0.6 and len(got) == 6
    for s in ("a", "b"):
        rows = known.where(f"series_id = '{s}'").toPandas()
        f, mutual = {}, {}
        for n in NAMES:
            x, y = rows[n].to_numpy(), rows["target"].to_numpy()
            r = np.corrcoef(x, y)[0, 1] if x.std() > 0 else 0.0
            f[n], mutual[n] = r * r / (1 - r * r) * (len(x) - 2), information.kraskov(x, y)
        want = {n: 0.5 * forest[n] + 0.3 * mutual[n] / (max(mutual.values()) + 1e-10) + 0.2 * f[n] / (max(f.values()) + 1e-10) for n in NAMES}
        for place, n in enumerate(sorted(NAMES, key=lambda n: (-want[n], n)), 1):
            assert got[s, n].composite == pytest.approx(want[n]) and got[s, n].place == place
        assert got[s, "good"].place == 1 and got[s, "good"].category == "other" and got[s, "cat_kind_noise"].category == "kind"
    assert ranking.ranked(matrix, NAMES, top=1).count() == 2


def test_categories_take_the_mean(spark):
    rows = [("a", "x", 0.4), ("a", "x", 0.2), ("a", "y", 0.5), ("b", "x", 0.1)]
    got = ranking.category_importance(spark.createDataFrame(rows, "series_id string, category string, composite double")).collect()
    assert sorted((r.series_id, r.place, r.category, round(r.importance, 9), r.n_features) for r in got) == [("a", 1, "y", 0.5, 1), ("a", 2, "x", 0.3, 2), ("b", 1, "x", 0.1, 1)]


def test_gaps_take_the_value_before(spark):
    day = lambda i: datetime.datetime(2020, 1, 1 + i)
    rows = [("a", day(0), None), ("a", day(1), 2.0), ("a", day(2), float("nan")), ("a", day(3), None), ("a", day(4), 5.0), ("b", day(0), float("nan"))]
    got = ranking.filled(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, x double"), ["x"]).orderBy("series_id", "ts").collect()
    assert [r.x for r in got] == [0, 2, 2, 2, 5, 0]


def test_flat_series_have_no_correlation(spark):
    day = lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i)
    bars = spark.createDataFrame([(s, day(i), 7.0 if s == "flat" else float(i % 5 + 1)) for s in ("flat", "moves") for i in range(90)], "series_id string, ts timestamp_ntz, close double")
    rows = features.rolling_autocorrelation(bars).where("series_id = 'flat'").collect()
    assert len(rows) == 90 and all(r.autocorrelation_1 is None for r in rows)
    values = bars.withColumnRenamed("close", "value")
    assert all(r.r is None for r in relations.lag_correlation(values, values).collect())
