"""Vectors of a table as rows of one length that are fit for comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import map_frames


def usable(vectors: DataFrame, row: str, keep: str = "") -> DataFrame:
    """(row, *keep, vector): double-precision components as binary; zeros without a sign; null where the vector is null, empty, zero or has null or non-finite components. keep: DDL of columns that go along."""
    names = [x.split()[0] for x in keep.split(",") if x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v in batch["embedding"]:
                v = np.zeros(0) if v is None else np.array([np.nan if x is None else x for x in v], np.float64) if v.dtype == object else np.asarray(v, np.float64)
                out.append((v + 0.0).astype("<f8").tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield batch.drop(columns="embedding").assign(vector=out)

    return map_frames(vectors.select(F.col(row).alias("row"), *names, "embedding"), run, "row long, " + "".join(f"{x.strip()}, " for x in keep.split(",") if x) + "vector binary")


def matrix(values: pd.Series) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
