"""Pieces that several operators share: shared storage, grouped tasks, word hashes and components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only on local masters, where all share one disk, is a folder of our own made if it is unset; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet into the shared folder, in folders by the columns by, and read it again, so that lost executors cost no recomputation; shuffle files of the write are removed when it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Remove tables of stored() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0].rsplit("/", 1)[0]) if table.inputFiles() else None
        if path is not None:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, made at once."""
    spark = df.sparkSession
    shared_folder(spark)
    return df.checkpoint()


def give_back() -> None:
    """Return memory that arrays and Arrow no longer use to the system: a worker lives on for other stages, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only some C libraries can
        pass


def map_frames(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, slice_bytes: int = 0) -> DataFrame:
    """mapInPandas by way of Arrow batches, where whole numbers stay exact beside nulls; batches of more than slice_bytes come in several frames."""

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, batch.num_rows * slice_bytes // max(1, batch.nbytes)) if slice_bytes else max(1, batch.num_rows)
            for low in range(0, batch.num_rows, step):
                yield batch.slice(low, step).to_pandas(integer_object_nulls=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(frames(batches)):
            if len(frame):
                yield from pa.Table.from_pandas(frame, schema=kind, preserve_index=False).to_batches()
        give_back()

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From a partition sorted by keys: frames of whole groups, and the bounds of the groups in each frame."""
    held: list[pd.DataFrame] = []

    def bounds(frame: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(frame), bool)
        change[0] = True
        for k in keys:
            values = frame[k].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(change), len(frame))

    for batch in batches:
        if not len(batch):
            continue
        last = bounds(batch)[-2]
        tail_key = batch[keys].iloc[0].tolist()
        if last == 0 and held and held[-1][keys].iloc[-1].tolist() == tail_key:
            held.append(batch)
            continue
        if last > 0:
            frame = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = [batch.iloc[last:]]
        else:
            frame, held = (pd.concat(held, ignore_index=True) if held else batch.iloc[:0]), [batch]
        if len(frame):
            yield frame, bounds(frame)
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, bounds(frame)


def in_groups(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, sort: tuple[str, ...] = (), parts: int = 0) -> DataFrame:
    """Deal rows out by keys, to so many parts if given, and run function on frames of whole groups; much cheaper than a call per group when most are tiny."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, cuts in whole_groups(batches, keys):
            out = function(frame, cuts)
            if len(out):
                yield out

    return map_frames(df.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *sort), run, schema)


def chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to about limit; a larger item stands alone."""
    low, total = 0, 0
    for i, size in enumerate(sizes):
        if i > low and total + size > limit:
            yield low, i
            low, total = i, 0
        total += int(size)
    if low < len(sizes):
        yield low, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of x over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after every text, and where each text begins (and the end)."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return buffer, begins


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word, the range of words of each text, and begin and end of each word in the joined buffer."""
    buffer, begins = joined_bytes(texts)
    blank = WHITESPACE[buffer]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(buffer) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    hashes = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, begins), start, end


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words and the range of them of each text; a text of fewer words gives one run of them all, none without words."""
    hashes, cuts, _, _ = words(texts)
    counts = np.diff(cuts)
    full = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        full = full * _BASE + padded[k : k + len(hashes)]
    short = (counts > 0) & (counts < width)
    for i in np.flatnonzero(short):
        value = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for h in hashes[cuts[i] : cuts[i + 1]]:
                value = value * _BASE + h
        full[cuts[i]] = value
    many = np.where(short, 1, np.maximum(counts - width + 1, 0))
    ends = np.cumsum(many)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(cuts[:-1] - (ends - many), many)
    return mix64(full[at]), np.concatenate([[0], ends]).astype(np.int64)


def encoded(texts: pd.Series) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def local_components(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index that each index reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

    edges: pairs (a, b) of any orderable type. Returns (id, component) for every id on an edge between two different
    ids; component is the smallest id reached. Every round is two aggregations and two joins, so a node with very many
    neighbours is split by adaptive skew joins; edges are checkpointed in the shared folder each round.
    """
    ordered = lambda df: df.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("x", "y") % 1_000_003), F.sum(F.xxhash64("y", "x") % 1_000_033)).first()
    now = checkpointed(ordered(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("x"), F.col("v").alias("y")).distinct()
        least = large.groupBy(F.col("y").alias("u")).agg(F.min("x").alias("m"))
        small = large.withColumnRenamed("y", "u").join(least, "u")
        new = checkpointed(ordered(small.select(F.col("m"), F.explode(F.array("u", "x")).alias("y")).select(F.col("m").alias("x"), "y")))
        found = mark(new)
        done, now, seen = found == seen, new, found
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("y").alias("id"), F.col("x").alias("component")).union(now.select(F.col("x").alias("id"), F.col("x").alias("component")).distinct())
