"""Embedding near-dedup: sorted passes over random projections find near pairs, whose groups are then compared exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.blocks import in_blocks, settled, smallest_linked
from periodica.llm.common import components, freed, in_groups, map_frames, stored
from periodica.llm.vectors import matrix, unit, usable

BITS = 62
ROWS_IN_BLOCK = 1024
#: Passes compare in single precision; pairs so far below the threshold still go to the exact comparison.
ROUNDING = 1e-5


def passes_needed(rows: int, shared: float, window: int, similarity: float, recall: float) -> int:
    """Passes after which a pair at the threshold has stood within a window of its label with probability recall.

    shared is the cosine that vectors of the label have on average. Directions go through the label's mean, so a pair is
    as far apart as it is without that common part, and log2(rows / window) signs leave a window of rows.
    """
    apart = math.acos(min(1.0, max(-1.0, (similarity - shared) / max(1 - shared, 1e-9)))) / math.pi
    met = (1 - apart) ** (max(0.0, math.log2(max(rows, 1) / window)) + 1)
    return max(2, math.ceil(math.log(1 - recall) / math.log1p(-min(max(met, 1e-12), 1 - 1e-9))))


def windows(x: np.ndarray, group: np.ndarray, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i > j >= i - window, of one group whose product is at least least, by bands of window rows."""
    a, b = [], []
    for low in range(0, len(x), window):
        high, before = min(low + window, len(x)), max(0, low - window)
        i, j = np.nonzero(x[low:high] @ x[before:high].T >= least)
        i, j = i + low, j + before
        near = (j < i) & (i - j <= window) & (group[i] == group[j])
        a.append(i[near])
        b.append(j[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n items."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def plans(classes: DataFrame, window: int, similarity: float, recall: float) -> DataFrame:
    """(label, passes, mean): mean direction of the distinct vectors of each label, from one sum of each task and label, and its passes: one where the window holds the whole label, 0 where the mean cosine itself is at the threshold."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for batch in batches:
            for label, part in batch.groupby("label"):
                own = total.setdefault(label, [0, 0.0])
                own[0] += len(part)
                own[1] = own[1] + unit(matrix(part["vector"])).sum(axis=0)
        yield pd.DataFrame([(k, n, s.astype("<f8").tobytes()) for k, (n, s) in total.items()], columns=["label", "n", "total"])

    def met(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(frame["n"].iloc[a:b].sum())
            mean = np.round(matrix(frame["total"].iloc[a:b]).sum(axis=0) / n, 4)  # rounded, so that reruns agree
            shared = float(mean @ mean)
            passes = 1 if n <= window + 1 else 0 if shared >= similarity else passes_needed(n, shared, window, similarity, recall)
            out.append((frame["label"].iloc[a], passes, mean.astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["label", "passes", "mean"])

    return in_groups(map_frames(classes.select("label", "vector"), summed, "label string, n long, total binary"), ["label"], met, "label string, passes int, mean binary")


def near_duplicates(vectors: DataFrame, similarity: float = 0.98, window: int = 64, recall: float = 0.9995, seed: int = 23) -> DataFrame:
    """Groups of near-equal vectors among rows of one label; vectors has vec_id, embedding and label.

    Equal vectors of a label are one from the start, with their number. Every pass gives each vector a code, the signs of
    its products with random directions through the mean of its label, one after the other, orders all vectors by label and code and compares
    each with the window before it, across the bounds of partitions too. Pairs at the threshold are united over all passes.
    Within each group so found every pair is compared once more in double precision, in blocks of bounded size, so that
    groups wider than a window lose no link; links and components follow from these comparisons alone.
    A label's number of passes follows from its rows, its mean, the window and the recall aimed at, at every size. Only a
    label of more than a window whose vectors have the threshold's cosine with each other on average is one group from the
    start: there a pair at the threshold is no nearer than any other, and the links to be counted are themselves as many as the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, of another length than the rest of their
    label's (each length is compared apart), or with a null label link with nothing. Null or repeated vec_ids are rows of
    their own. Extra columns are ignored; an empty table gives no rows.

    Returns one row per row: vec_id, n_links, component_id (smallest vec_id that links lead to), kept.
    """
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("string").alias("label"), "embedding")
    named = usable(numbered, "row", "vec_id long, label string").withColumn("label", F.concat_ws(":", F.length("vector"), F.col("label")))
    fits = F.col("vector").isNotNull() & F.col("label").contains(":")
    each = stored(named.withColumn("key", F.when(fits, F.md5(F.concat(F.col("label").cast("binary"), F.col("vector"))))).withColumn("vector", F.when(fits, F.col("vector"))), "vectors")
    classes = stored(each.where("key is not null").groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("vector").alias("vector")), "vector-classes")
    stated = stored(classes.select("row", "label", "vector").join(plans(classes, window, similarity, recall), "label"), "vector-stated")

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, part in batch.groupby("label"):
                x, centre = unit(matrix(part["vector"])), np.frombuffer(part["mean"].iloc[0], "<f8")
                binary = [v.tobytes() for v in x.astype("<f4")]
                for p in range(part["passes"].iloc[0]):
                    directions = np.random.Generator(np.random.PCG64([seed, p, x.shape[1]])).standard_normal((x.shape[1], BITS))
                    code = ((x - centre) @ directions > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1])
                    yield pd.DataFrame({"pass": p, "label": label, "code": code, "row": part["row"], "vector": binary})

    order = ["pass", "label", "code", "row"]
    columns = ["a", "b", "bound", *order, "vector"]
    codes = map_frames(stated.where("passes > 0"), coded, "pass int, label string, code long, row long, vector binary")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    lined = codes.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        group = pd.factorize(frame["pass"].astype(str) + ":" + frame["label"])[0]
        width = max(map(len, frame["vector"]))
        x = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in frame["vector"]), "<f4").reshape(len(frame), -1)
        root = rooted(len(frame), *windows(x, group, window, similarity - ROUNDING))
        rows = frame["row"].to_numpy()
        far = root != np.arange(len(frame))
        return pd.DataFrame({"a": rows[far], "b": rows[root[far]]})

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Edges of the partition, and its first and last rows for the two bounds it shares."""
        at, held, first = TaskContext.get().partitionId(), None, []
        for batch in batches:
            if sum(map(len, first)) < window:
                first.append(batch.iloc[: window - sum(map(len, first))])
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = frame.iloc[-window:]
            yield compared(frame).astype(object).reindex(columns=columns)
        if held is not None:
            yield pd.concat([pd.concat(first).assign(bound=at), held.assign(bound=at + 1)]).reindex(columns=columns)

    walks = stored(map_frames(lined, walked, "a long, b long, bound int, pass int, label string, code long, row long, vector binary"), "vector-walks")
    seams = in_groups(walks.where("bound is not null").select("bound", *order, "vector"), ["bound"], lambda frame, cuts: pd.concat([compared(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]), "a long, b long", tuple(order))
    edges = stored(walks.where("bound is null").select("a", "b").union(seams).distinct(), "vector-edges")
    freed(walks)
    dense = stated.where("passes = 0").select("row", F.col("label").alias("component"))
    candidates = components(edges).select(F.col("id").alias("row"), F.col("component").cast("string").alias("component")).union(dense)

    def exact(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = frame.iloc[a:b].sort_values("row")
            x = unit(matrix(part["vector"]))
            linked = x @ x.T >= similarity
            np.fill_diagonal(linked, False)
            if part["low"].iloc[0] != part["high"].iloc[0]:
                block = part["block"].to_numpy()
                linked &= block[:, None] != block[None, :]
            rows = part["row"].to_numpy()
            out.append(pd.DataFrame({"key": rows, "root": rows[smallest_linked(linked)], "links": linked @ part["copies"].to_numpy(), "whole": bool(part["blocks"].iloc[0] == 1)}))
        return pd.concat(out)

    members = candidates.join(classes.select("row", "vector", "copies"), "row")
    links = stored(in_blocks(members, "component", "row", ROWS_IN_BLOCK, exact, "key long, root long, links long, whole boolean"), "vector-links")
    joined = stored(classes.select("key", "row", "copies", "least_id").join(settled(links).withColumnRenamed("key", "row"), "row", "left").withColumn("component", F.coalesce("component", "row")), "vector-components")
    least_id = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = joined.join(least_id, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    freed(stated, edges, links)
    out = each.select("vec_id", "key").join(placed, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
