"""Features of cycle phases, the filled feature matrix, and the ranking of its columns against an aim."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import whole
from periodica.operators import features as technical
from periodica.operators import information, models
from periodica.operators.cleaning import numbered

#: Shares of the forest's importance, the mutual information and the F score in the composite.
SHARES = {"rf_importance": 0.5, "mi_score": 0.3, "f_norm": 0.2}


def phase_features(bars: DataFrame, cycles: DataFrame, most: int = 10) -> DataFrame:
    """(series_id, ts, rank, cycle_sin, cycle_cos, cycle_amplitude) of each bar for the strongest most cycles (series_id, rank, period, phase, amplitude) of its series.

    A row for each bar and cycle, by an equi-join on the series with at most most rows a series; series without cycles give none.
    """
    met = numbered(bars).select("series_id", "ts", "bar").join(cycles.where(F.col("rank") <= most).select("series_id", "rank", "period", "phase", "amplitude"), "series_id")
    angle = 2 * math.pi * F.col("bar") / F.col("period") + F.col("phase")
    return met.select("series_id", "ts", "rank", F.sin(angle).alias("cycle_sin"), F.cos(angle).alias("cycle_cos"), F.col("amplitude").alias("cycle_amplitude"))


def filled(features: DataFrame, names: list[str]) -> DataFrame:
    """The named columns with gaps (null or not a number) filled by the last value before in the series, and by 0 where there is none; other columns stay."""
    upto = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    return features.withColumns({n: F.coalesce(F.last(known(n), ignorenulls=True).over(upto), F.lit(0.0)) for n in names})


def f_ranking(matrix: DataFrame, names: list[str], aim: str = "target") -> DataFrame:
    """(series_id, feature, n, f_score, f_norm): one-factor F statistic, and relative to the largest of the series; 0 for constant features."""
    scored = technical.f_scores(matrix, names, aim).select("series_id", "feature", "n", "f_score")
    return scored.withColumn("f_norm", F.col("f_score") / (F.max("f_score").over(whole()) + 1e-10))


def category(name: Column) -> Column:
    """The second part of names that begin with cat_, other for the rest."""
    return F.when(name.startswith("cat_"), F.split(name, "_")[1]).otherwise("other")


def ranked(matrix: DataFrame, names: list[str], aim: str = "target", top: int = 50, seed: int = 42) -> DataFrame:
    """(series_id, place, feature, category, rf_importance, mi_score, f_norm, composite): the first top features of each series by their composite score, ties by name.

    matrix has no gaps in names; rows without aim take no part. F scores and mutual information are those of each series; the forest (100 trees of depth 6,
    the root of the features at each split) is one over all series, since it is a distributed model and not a task's. The forest's table
    has a row for each name and is the only one broadcast.
    """
    rows = matrix.where(F.col(aim).isNotNull()).select("series_id", "ts", aim, *names)
    forest = models.forest_importance(rows, names, aim, seed).select("feature", F.col("importance").alias("rf_importance"))
    both = f_ranking(rows, names, aim).join(information.mutual_information(rows, names, aim).select("series_id", "feature", "mi_score"), ["series_id", "feature"])
    out = both.join(F.broadcast(forest), "feature").withColumn("composite", sum((F.col(c) * share for c, share in SHARES.items()), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("composite"), "feature"))
    out = out.withColumn("place", place).where(F.col("place") <= top)
    return out.select("series_id", "place", "feature", category(F.col("feature")).alias("category"), "rf_importance", "mi_score", "f_norm", "composite")


def category_importance(ranking: DataFrame) -> DataFrame:
    """(series_id, place, category, importance, n_features): mean composite score of each category, the largest first."""
    means = ranking.groupBy("series_id", "category").agg(F.avg("composite").alias("importance"), F.count("*").alias("n_features"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("importance"), "category")))
