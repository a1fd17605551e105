import datetime
import math

from pyspark.sql import functions as F

from periodica.operators import cleaning, features, relations, spectral
from periodica.sources import bars
from periodica.streaming.bars import tick_bars

KIND = "series_id string, ts timestamp_ntz, close double"
START = datetime.datetime(2020, 1, 1)


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, START + datetime.timedelta(days=i), v) for i, v in enumerate(values)], KIND)


def test_gaps_fill_by_a_line_then_carry_then_go(spark):
    values = [1.0, None, 3.0] + [None] * 9 + [13.0, None]
    got = [(r.ts - START).days for r in cleaning.interpolate(series(spark, values)).orderBy("ts").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13]
    by_day = {(r.ts - START).days: r.close for r in cleaning.interpolate(series(spark, values)).collect()}
    assert by_day[1] == 2.0 and by_day[5] == 6.0 and by_day[9] == 8.0 - 0.0 and by_day[13] == 13.0


def test_sine_is_found_and_other_series_do_not_matter(spark):
    wave = series(spark, [100 + 5 * math.sin(2 * math.pi * i / 20) for i in range(400)])
    other = series(spark, [50.0 + (i * 7919 % 13) for i in range(77)], "b")
    best = lambda df: spectral.periodogram(cleaning.detrend_linear(df), "detrended").where("series_id = 'a'").orderBy(F.desc("power")).first()
    alone, both = best(wave), best(wave.union(other))
    assert alone.period == 20 and (alone.k, round(alone.power, 9)) == (both.k, round(both.power, 9))


def test_exponential_average_is_the_recursion(spark):
    values = [float((i * 37) % 11) for i in range(90)]
    y, want = values[0], []
    for v in values:
        y = 2 / 13 * v + (1 - 2 / 13) * y
        want.append(y)
    got = [r.ema_12 for r in features.emas(series(spark, values), "close", (12,)).orderBy("ts").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_edges(spark):
    for n in (0, 1, 2, 9, 31):
        assert cleaning.preprocess(series(spark, [5.0 + i % 3 for i in range(n)])).count() == n
        assert spectral.periodogram(series(spark, [1.0 + i % 3 for i in range(n)]), "close").count() == 0
    assert relations.analogs(series(spark, [1.0] * 60)).count() == 0


def test_payload_shapes(spark):
    arrays = spark.createDataFrame([("a", [0, 86400], [1.0, 2.0], [1.0, 2.0], [1.0, 2.0], [1.5, 0.0], [9.0, 9.0])], "series_id string, timestamp array<long>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>")
    assert [r.close for r in bars.from_parallel_arrays(arrays).collect()] == [1.5]
    body = '{"2020-01-02": {"1. open": "1", "2. high": "3", "3. low": "1", "4. close": "2", "5. volume": "7"}}'
    assert [(r.close, r.volume) for r in bars.from_time_map(spark.createDataFrame([("a", body)], "series_id string, body string")).collect()] == [(2.0, 7.0)]
    body = '[{"datetime": "2020-01-02 10:00:00", "open": "1", "high": "3", "low": "1", "close": "2", "volume": null}, {"datetime": "x", "close": "3"}]'
    assert [(r.close, r.volume) for r in bars.from_records(spark.createDataFrame([("a", body)], "series_id string, body string")).collect()] == [(2.0, 0.0)]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Close\n2020-01-02,5\n2020-01-03,-1\nbad,4\n")
    read = bars.read_csv(spark, str(tmp_path / "x.csv"), "x")
    assert [(r.series_id, r.close) for r in read.collect()] == [("x", 5.0)]
    bars.write_parquet(read, str(tmp_path / "bars"))
    assert bars.read_parquet(spark, str(tmp_path / "bars")).count() == 1
    ticks = spark.createDataFrame([("a", START + datetime.timedelta(minutes=10 * i), float(i)) for i in range(12)], "series_id string, ts timestamp, price double")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = tick_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")))
    query = stream.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.open, r.close, r.volume) for r in spark.table("bars_out").collect()) == [(0.0, 5.0, 6.0), (6.0, 11.0, 6.0)]
