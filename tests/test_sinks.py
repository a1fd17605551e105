"""Writing again replaces a job's own rows: two runs, one set of rows."""

import json

from pyspark.sql import functions as F

from periodica.sources import sinks

CYCLES = "series_id string, period double, strength double"


def test_a_rerun_replaces_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "cycles")
    first = spark.createDataFrame([(s, float(p), (p * 37 % 100) / 100) for s in "ab" for p in range(50)], CYCLES)
    sinks.save_cycles(first, path, "one")
    sinks.save_cycles(first, path, "two")
    sinks.save_cycles(first, path, "two")
    counts = {(r.job_id, r.series_id): r["count"] for r in spark.read.parquet(path).groupBy("job_id", "series_id").count().collect()}
    assert counts == {(j, s): 30 for j in ("one", "two") for s in "ab"}
    sinks.save_cycles(spark.createDataFrame([("c", 5.0, 0.9)], CYCLES), path, "one")
    assert {(r.job_id, r.series_id) for r in spark.read.parquet(path).collect()} == {("one", "c"), ("two", "a"), ("two", "b")}
    best = sinks.strongest(spark, path, "two", 0.5, 7).collect()
    assert len(best) == 7 and [r.strength for r in best] == sorted((r.strength for r in best), reverse=True) and min(r.strength for r in best) >= 0.5


def test_jobs_are_told_by_status_and_page(spark, tmp_path):
    path, day = str(tmp_path / "jobs"), lambda d: F.lit(f"2024-01-{d:02d}")
    for i in range(1, 6):
        sinks.save_job(spark, path, f"job{i}", "running", day(i))
    for _ in range(2):
        sinks.save_job(spark, path, "job3", "completed", day(3), day(9), spark.createDataFrame([(4, "a")], "n int, best string"))
    assert [r.job_id for r in sinks.jobs(spark, path, offset=1, limit=3).collect()] == ["job4", "job3", "job2"]
    done = sinks.jobs(spark, path, "completed").collect()
    assert [r.job_id for r in done] == ["job3"] and json.loads(done[0].result_summary) == {"n": 4, "best": "a"} and done[0].completed_at.day == 9
    assert all(r.result_summary is None and r.completed_at is None for r in sinks.jobs(spark, path, "running").collect())


def test_a_replayed_batch_leaves_one_set(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.6)], CYCLES).write.parquet(source)
    stream = spark.readStream.schema(CYCLES).parquet(source)
    for attempt in range(2):  # a lost checkpoint replays all batches
        sinks.save_stream(stream, path, "live", str(tmp_path / f"checkpoint{attempt}")).awaitTermination()
    assert sorted((r.series_id, r.job_id) for r in spark.read.parquet(path).collect()) == [("a", "live"), ("b", "live")]
