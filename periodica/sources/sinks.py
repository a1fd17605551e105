"""Result and job tables keyed by job: writing a job again replaces its own rows and no others, so reruns and replayed batches leave one set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOB = "job_id string, status string, queued_at timestamp_ntz, completed_at timestamp_ntz, result_summary string"


def save(rows: DataFrame, path: str, job_id: str, **keys: object) -> None:
    """Write rows as the partition job_id (and further keys) of the table at path. Only partitions that are written are replaced, when the job's output is complete; a job without rows replaces nothing."""
    named = rows.withColumns({k: F.lit(v) for k, v in {"job_id": job_id, **keys}.items()})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", *keys).parquet(path)


def save_cycles(cycles: DataFrame, path: str, job_id: str, most: int = 30) -> None:
    """The strongest cycles of each series (series_id, period, strength, ...), ties to the shorter period."""
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("strength"), "period"))
    save(cycles.withColumn("_place", place).where(F.col("_place") <= most).drop("_place"), path, job_id)


def save_job(spark: SparkSession, path: str, job_id: str, status: str, queued_at: Column, completed_at: Column | None = None, summary: DataFrame | None = None) -> None:
    """One row of a job: its status, times, and the single row of summary as JSON."""
    done = F.lit(None).cast("timestamp_ntz") if completed_at is None else completed_at.cast("timestamp_ntz")
    row = spark.range(1).select(F.lit(None).cast("string").alias("result_summary")) if summary is None else summary.limit(1).select(F.to_json(F.struct("*")).alias("result_summary"))
    save(row.select(F.lit(status).alias("status"), queued_at.cast("timestamp_ntz").alias("queued_at"), done.alias("completed_at"), "result_summary"), path, job_id)


def save_stream(rows: DataFrame, path: str, job_id: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's batches until it has no more, each as a partition of its own: a batch that is replayed after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        save(batch, path, job_id, batch=number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jobs(spark: SparkSession, path: str, status: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """Jobs, the last queued first, of one status if given: a page of them."""
    rows = spark.read.schema(JOB).parquet(path)
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("queued_at"), "job_id").offset(offset).limit(limit)


def strongest(spark: SparkSession, path: str, job_id: str, least: float = 0.0, most: int = 20) -> DataFrame:
    """Saved cycles of a job of at least a strength, the strongest first."""
    return spark.read.parquet(path).where((F.col("job_id") == job_id) & (F.col("strength") >= least)).orderBy(F.desc("strength"), "series_id", "period").limit(most)
