import datetime

import pytest

from periodica.operators import cleaning, joins, patterns, report
from periodica.sources import routing

DAY = datetime.datetime(2024, 1, 1)
BAR = "series_id string, ts timestamp_ntz, close double"


def bars(spark, values, series="s"):
    return spark.createDataFrame([(series, DAY + datetime.timedelta(days=i), v) for i, v in enumerate(values)], BAR)


def test_routes_try_in_order_and_name_attempts(spark):
    rows = [("a", "dhan", 12), ("a", "yahoo", 50), ("b", "dhan", 9), ("b", "stooq", 10), ("c", "twelve_data", 30), ("d", "yahoo", 3), ("e", "alpha_vantage", 20)]
    table = spark.createDataFrame([(s, p, i) for s, p, n in rows for i in range(n)], "series_id string, source string, ts int")
    wanted = spark.createDataFrame([(s, "alpha_vantage" if s == "e" else "dhan") for s in "abcdef"] + [("a", "dhan"), (None, "dhan"), ("g", None)], "series_id string, primary string")
    found = {r.series_id: (r.provider, r.fell_back, r.attempts) for r in routing.routes(table, wanted).collect()}
    assert found == {
        "a": ("dhan", False, ["dhan"]), "b": ("stooq", True, ["dhan", "yahoo", "stooq"]), "c": (None, True, ["dhan", *routing.FALLBACKS]), "d": (None, True, ["dhan", *routing.FALLBACKS]),
        "e": ("alpha_vantage", False, ["alpha_vantage"]), "f": (None, True, ["dhan", *routing.FALLBACKS]),
    }
    opened = {r.series_id: r.provider for r in routing.routes(table, wanted, sessions=("twelve_data",)).collect()}
    assert opened["c"] == "twelve_data"
    alone = {r.series_id: (r.provider, r.attempts) for r in routing.routes(table, wanted, fallback=False).collect()}
    assert alone["b"] == (None, ["dhan"])
    assert routing.routed(table, wanted).count() == 12 + 10 + 20
    assert routing.routes(table.limit(0), wanted.limit(0)).collect() == []


def test_catalog_and_suggestions(spark):
    assert routing.providers(spark).count() == 10 and routing.providers(spark, "india").count() == 5
    rows = [("BTC/USDT", "dhan"), (" nifty 50 ", "dhan"), ("TCS.NS", "nobody"), ("TCS.BO", "fyers"), ("TCS.BO", None), ("AAPL", "dhan"), (None, "dhan"), ("BTCUSDT", None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, symbol string, broker string")
    found = table.select("i", routing.suggested(table.symbol, table.broker).alias("p")).orderBy("i").collect()
    assert [r.p for r in found] == ["ccxt", "dhan", "yahoo", "fyers", "yahoo", "yahoo", "yahoo", "yahoo"]


def test_requests(spark):
    texts = ["Find strongest cycles", "Find hidden relationships", "What happened in similar historical periods", "", None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = [r.m for r in table.select("i", report.requested_modules(table.text).alias("m")).orderBy("i").collect()]
    assert found == [
        ["preprocessing", "cycle_detection", "stability"], ["preprocessing", "features", "planetary", "cycle_detection"], ["preprocessing", "cycle_detection", "stability", "analog"], ["preprocessing"], ["preprocessing"],
    ]
    free = [r.m for r in table.select("i", report.requested_modules(table.text, True).alias("m")).orderBy("i").collect()]
    assert free[0] == free[1] == ["preprocessing", "cycle_detection"] and free[3] == ["preprocessing"]


def test_findings(spark):
    cycles = spark.createDataFrame([("s", float(10 * i), i / 10, "fft") for i in range(1, 8)], "series_id string, period double, strength double, method string")
    stable = spark.createDataFrame([("s", 20.0, 0.5, True), ("s", 30.0, 0.9, False)], "series_id string, period double, stability_score double, is_stable boolean")
    outlook = spark.createDataFrame([("s", -0.0123, 0.9), ("t", 0.0, 0.9), ("u", None, 0.5)], "series_id string, projected_5 double, confidence double")
    found = report.key_findings(cycles, stable, outlook).orderBy("section", "place").collect()
    assert [r.finding for r in found if r.section == "dominant_cycles"] == [f"Dominant cycle detected: {10 * i} bars (strength={i / 10:.2f}, method=fft)" for i in (7, 6, 5, 4, 3)]
    assert [r.finding for r in found if r.section == "stable_cycles"] == ["Stable cycle: 20 bars (stability=0.50)"]
    assert [(r.series_id, r.finding) for r in found if r.section == "outlook"] == [("s", "Historical analogs suggest bearish outcome (5d projection: -1.23%, confidence: 90%)")]
    with pytest.raises(ValueError):
        report.key_findings()


def test_labels_and_digits(spark):
    rows = [(730.0, 0.7), (364.0, 0.4), (8.0, 0.39), (2.5, 0.0)]
    table = spark.createDataFrame([(float(i), p, s, 0.00012345) for i, (p, s) in enumerate(rows)], "i double, period double, strength double, power double")
    found = table.select(report.period_label(table.period).alias("p"), report.strength_label(table.strength).alias("s")).collect()
    assert [tuple(r) for r in found] == [("2.0Y", "High"), ("12M", "Medium"), ("1W", "Low"), ("3D", "Low")]
    assert report.serialised(table).first().power == 0.0001
    assert report.analysis_column("ml") == "vol_adjusted" and report.analysis_column("close") == "close"


def test_turning_cycles_of_a_regular_wave(spark):
    """A wave of 8 bars: maxima and minima 4 bars apart, so every run of steps repeats."""
    wave = [0, 1, 2, 1, 0, -1, -2, -1] * 8
    found = patterns.turning_cycles(bars(spark, [10.0 + v for v in wave])).collect()
    assert {r.pattern_id for r in found if r.length == 2} == {"4:min>4:max", "4:max>4:min"}
    assert all(r.end_bar - r.start_bar == 4 * r.length for r in found)
    ends = [r for r in found if r.end_bar + 5 >= len(wave)]
    assert ends and all(r.forward_5 is None for r in ends) and all(r.forward_5 is not None for r in found if r.end_bar + 5 < len(wave))
    assert patterns.turning_cycles(bars(spark, [10.0 + v for v in wave[:16]])).collect() == []


def test_volatility_cycles_need_three_runs(spark):
    loud = lambda i: 1.0 + 0.2 * (i % 2)
    values = [100.0 * (loud(i) if (i // 40) % 3 == 2 else 1.0 + 0.001 * (i % 3)) for i in range(420)]
    found = patterns.volatility_cycles(bars(spark, values)).where("pattern_id = 'volcycle_high_vol'").collect()
    assert len(found) == 3 and all(r.end_bar > r.start_bar for r in found)
    assert patterns.volatility_cycles(bars(spark, values[:200])).where("pattern_id = 'volcycle_high_vol'").collect() == []


def test_gaps_stay_gaps_when_clipped(spark):
    table = bars(spark, [1.0, 2.0, None, 3.0, 4.0, 1000.0])
    assert [r.clipped for r in cleaning.iqr_clip(table, width=1.0).orderBy("ts").collect()][2] is None
    assert [r.winsorized for r in cleaning.winsorize(table, share=0.2).orderBy("ts").collect()] == [2.0, 2.0, None, 3.0, 4.0, 4.0]
    first = cleaning.preprocess(bars(spark, [100.0 + (7 * i) % 11 for i in range(60)])).orderBy("ts").first()
    assert first.log_return is None


def test_joins_of_two_tables(spark):
    left, right = bars(spark, [1.0, 2.0, 3.0]), bars(spark, [2.0, 4.0]).union(bars(spark, [9.0] * 2))
    assert joins.present(left, right).count() == 2 and joins.absent(left, right).count() == 1
    assert joins.set_sizes(left, right).collect()[0][1:] == (3, 2, 1, 0)
    assert joins.aligned(left, bars(spark, [5.0]), ["close"]).where("close_right is null").count() == 2
    assert joins.set_sizes(left.limit(0), right.limit(0)).collect() == []
