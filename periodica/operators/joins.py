"""Joins by time and interval, fallback among sources, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str = "ts", bucket: str = "month") -> DataFrame:
    """Each row of left with the last row of right of the same keys by that row's time or before, in columns of right that left does not have (null without one).

    Both sides are ordered together within keys and calendar buckets, so that one key's rows need not fit in a task; the last
    row of right before each bucket is carried into it from one row a bucket. Of several rows of right at one time, the last by their values counts.
    """
    new = [c for c in right.columns if c not in (*by, ts)]
    packed = F.struct(ts, *new)
    rows = left.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType))
    marks = right.select(*by, ts, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*by, ts)], F.lit(0).alias("_side"), packed.alias("_r"))
    both = rows.unionByName(marks).withColumn("_b", F.date_trunc(bucket, ts))
    lasts = both.groupBy(*by, "_b").agg(F.max("_r").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*by, "_b", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    within = Window.partitionBy(*by, "_b").orderBy(ts, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_now", F.last("_r", ignorenulls=True).over(within)).where("_side = 1")
    keys = [met[k].eqNullSafe(carried[k]) for k in (*by, "_b")]
    out = met.join(carried, keys, "left").select(*[met[c] for c in left.columns], F.coalesce(met["_now"], carried["_before"]).alias("_found"))
    return out.select(*left.columns, *[F.col("_found")[c].alias(c) for c in new])


def within_intervals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Every point with every interval (low to high, both included) that holds it: points and intervals meet in cells of width, by an equi-join."""
    cell = lambda x: F.floor(F.col(x).cast("double") / width)
    spread = intervals.where(F.col(high) >= F.col(low)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(at)).join(spread, "_cell").where(F.col(at).between(F.col(low), F.col(high))).drop("_cell")


def first_available(bars: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Bars of each series from the first of the sources in order that has any; sources not named come last, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0)), F.lit(len(order) + 1))
    key = F.struct(place.alias("place"), F.col(source).alias("name"))
    best = bars.groupBy("series_id").agg(F.min(key).alias("_best"))
    return bars.join(best, "series_id").where(F.col(source) == F.col("_best.name")).drop("_best")


def histogram(bars: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(series_id, bin, low, high, n): counts in bins of equal width from the least to the largest value of each series, which falls in the last; empty bins are left out."""
    ends = bars.groupBy("series_id").agg(F.min(column).alias("_least"), F.max(column).alias("_most"))
    step = (F.col("_most") - F.col("_least")) / bins
    rows = bars.where(F.col(column).isNotNull()).join(ends, "series_id").withColumn("_step", F.when(step > 0, step).otherwise(1.0))
    rows = rows.withColumn("bin", F.least(F.floor((F.col(column) - F.col("_least")) / F.col("_step")), F.lit(bins - 1)).cast("int"))
    edge = lambda k: F.col("_least") + (F.col("bin") + k) * F.col("_step")
    return rows.groupBy("series_id", "bin", "_least", "_step").agg(F.count("*").alias("n")).select("series_id", "bin", edge(0).alias("low"), edge(1).alias("high"), "n")


def outlier_counts(bars: DataFrame, column: str, width: float = 3.0) -> DataFrame:
    """(series_id, n, outliers): values outside the quartiles by more than width times their distance."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    fences = bars.groupBy("series_id").agg(q.alias("_q"))
    wide: Column = width * (F.col("_q")[1] - F.col("_q")[0])
    out = (F.col(column) < F.col("_q")[0] - wide) | (F.col(column) > F.col("_q")[1] + wide)
    return bars.join(fences, "series_id").groupBy("series_id").agg(F.count(column).alias("n"), F.count_if(out).alias("outliers"))


def aligned(left: DataFrame, right: DataFrame, columns: list[str], names: tuple[str, str] = ("left", "right"), by: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """Full outer join of two tables by keys: <column>_<name> of both sides, null where a side has no row. Null keys meet nothing and stay."""
    sides = [side.select(*by, *[F.col(c).alias(f"{c}_{n}") for c in columns]) for side, n in zip((left, right), names, strict=True)]
    return sides[0].join(sides[1], list(by), "full")


def present(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """Rows of left whose keys right has, each once however often right has them."""
    return left.join(right.select(*by), list(by), "left_semi")


def absent(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """Rows of left whose keys right does not have; rows with a null key stay."""
    return left.join(right.select(*by), list(by), "left_anti")


def set_sizes(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("series_id",), of: str = "ts") -> DataFrame:
    """For each group of by how many different values of of are in either side, in both, and in one only: (by, n_either, n_both, n_left, n_right), by one grouping of both sides together."""
    side = lambda rows, bit: rows.select(*by, of).withColumn("_side", F.lit(bit))
    each = side(left, 1).unionByName(side(right, 2)).groupBy(*by, of).agg(F.bit_or("_side").alias("_sides"))
    count = lambda s: F.count_if(F.col("_sides") == s)
    return each.groupBy(*by).agg(F.count("*").alias("n_either"), count(3).alias("n_both"), count(1).alias("n_left"), count(2).alias("n_right"))
