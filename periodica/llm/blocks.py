"""Comparing all members of a group in bounded blocks, whatever the size of the group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import components, in_groups


def in_blocks(rows: DataFrame, group: str, spread: str, rows_in_block: int, function: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, volume: str | None = None, volume_in_block: int = 0) -> DataFrame:
    """Run function on every pair of blocks of every group.

    A group of n rows is split by the hash of spread into blocks of about rows_in_block rows (or volume_in_block of the
    column volume); each row goes to the pairs of its own block with every block of its group. Frames have the columns of
    rows, block, low and high, the two blocks that meet (equal for a block with itself), and blocks, the group's number of them; cuts bound the pairs.
    """
    parts = F.ceil(F.count("*") / rows_in_block)
    if volume:
        parts = F.greatest(parts, F.ceil(F.sum(volume) / volume_in_block))
    sizes = rows.groupBy(group).agg(parts.cast("int").alias("blocks"))
    split = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(spread, F.lit(17)), "blocks").cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    return in_groups(split, [group, "low", "high"], function, schema)


def smallest_linked(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index in the component of each index, by breadth-first search over rows."""
    n = len(linked)
    label = np.full(n, -1)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        front = np.array([start])
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & (label < 0))
            label[new] = start
            front = new
    return label


def settled(links: DataFrame) -> DataFrame:
    """(key, component, links) from rows (key, root, links, whole) of pairs of blocks; groups of one block need no more than their root."""
    whole = links.where("whole").select("key", F.col("root").alias("component"), "links")
    split = links.where("not whole")
    if not split.take(1):
        return whole
    joined = components(split.where(F.col("key") != F.col("root")), "key", "root").withColumnRenamed("id", "key")
    return whole.union(split.groupBy("key").agg(F.sum("links").alias("links")).join(joined, "key", "left").select("key", F.coalesce("component", "key"), "links"))
