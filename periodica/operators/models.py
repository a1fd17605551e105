"""Learned parts, with pyspark.ml: window shapes and their clusters, embeddings with reconstruction errors, feature importance."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.rolling import whole
from periodica.operators.cleaning import numbered


def hopping_windows(bars: DataFrame, column: str = "close", width: int = 20, step: int | None = None) -> DataFrame:
    """(series_id, start_bar, end_bar, window): z-scored windows of width bars at every step (a quarter of width if not given); flat ones are left out."""
    step = step or max(1, width // 4)
    over = Window.partitionBy("series_id").orderBy("bar").rowsBetween(0, width - 1)
    rows = numbered(bars).withColumn("_n", F.count("*").over(whole())).withColumn("_w", F.collect_list(F.col(column).cast("double")).over(over)).withColumn("_m", F.avg(column).over(over)).withColumn("_s", F.stddev_pop(column).over(over))
    rows = rows.where((F.col("bar") % step == 0) & (F.col("bar") < F.col("_n") - width) & (F.col("_s") > 1e-8))
    return rows.select("series_id", F.col("bar").alias("start_bar"), (F.col("bar") + width).alias("end_bar"), F.transform("_w", lambda v: (v - F.col("_m")) / F.col("_s")).alias("window"))


def shape_clusters(windows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Clusters of window shapes over all series: adds cluster and the cosine to the cluster's mean shape."""
    rows = windows.withColumn("features", array_to_vector("window"))
    model = KMeans(k=k, seed=seed).fit(rows)
    out = model.transform(rows).drop("features").withColumnRenamed("prediction", "cluster")
    centres = windows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")  # k rows
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    out = out.join(F.broadcast(centres), "cluster")
    return out.withColumn("similarity", dot("window", "centre") / (F.sqrt(dot("window", "window") * dot("centre", "centre")) + 1e-10)).drop("centre")


def linear_embeddings(windows: DataFrame, size: int = 8) -> DataFrame:
    """A linear autoencoder: principal components as embedding, mean squared reconstruction error, and that error scaled to 0..1 within its series as anomaly."""
    rows = windows.withColumn("features", array_to_vector("window"))
    model = PCA(k=size, inputCol="features", outputCol="coded").fit(rows)
    axes = model.pc.toArray()
    out = model.transform(rows).withColumn("embedding", vector_to_array("coded"))
    back = F.array(*[sum((F.col("embedding")[j] * float(axes[i, j]) for j in range(size)), F.lit(0.0)) for i in range(axes.shape[0])])
    error = F.aggregate(F.zip_with("window", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / axes.shape[0]
    out = out.drop("features", "coded").withColumn("reconstruction_error", error)
    low, high = F.min("reconstruction_error").over(whole()), F.max("reconstruction_error").over(whole())
    return out.withColumn("anomaly_score", (F.col("reconstruction_error") - low) / (high - low + 1e-10))


def forest_importance(features: DataFrame, names: list[str], aim: str = "target", seed: int = 42, trees: int = 100, depth: int = 6) -> DataFrame:
    """(feature, importance) of a random forest for aim; each split tries the root of the number of features."""
    rows = VectorAssembler(inputCols=names, outputCol="_features").transform(features.where(F.col(aim).isNotNull()).select(aim, *names).na.fill(0.0))
    model = RandomForestRegressor(featuresCol="_features", labelCol=aim, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(rows)
    return features.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
