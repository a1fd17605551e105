"""Lines that many documents repeat: levelled sorted runs of line hashes, to which batches of documents are added one after another."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm.common import CLEANUP, encoded, freed, map_frames, shared_folder, stored

BLANK = b" \t\n\v\f\r"
KEY = ["high", "low"]
#: Keys of at least one in so many of all lines are hot: there are no more than so many of them, so they may be broadcast.
HOT = 10_000
#: Texts are cut into lines in frames of about so many bytes.
SLICE_BYTES = 4 << 20


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """128-bit hash of a line without outer blanks, with A to Z lower-cased; None if that has fewer code points than least_chars."""
    line = line.strip(BLANK).lower()  # of bytes, so of A to Z alone
    if len(line) < least_chars or not line.isascii() and len(line.decode("utf-8", "surrogatepass")) < least_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def line_hashes(docs: DataFrame, least_chars: int, batches: int) -> DataFrame:
    """A row (doc_id, batch, high, low) for each different key of a row's text; all rows of a doc_id are of one batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [{k for line in text.split(b"\n") if (k := line_key(line, least_chars))} for text in encoded(frame["text"])]
            each = [len(keys) for keys in found]
            halves = np.frombuffer(b"".join(k for keys in found for k in keys), ">i8").astype(np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": frame["doc_id"].repeat(each).array, "batch": frame["batch"].repeat(each).array, "high": halves[:, 0], "low": halves[:, 1]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    return map_frames(rows, run, "doc_id long, batch int, high long, low long", SLICE_BYTES)


class LineRuns:
    """Runs of line keys, each a table in buckets sorted by key, in levels: a level that holds fanout runs is compacted into one run of the next.

    A batch's keys are counted, then merge-joined with every run (the same buckets, so no run is shuffled). Keys that no
    run has are the batch's own (fresh); those that some run has are kept beside them as further counts (fresh is
    false). So fresh keys of all runs are disjoint, and what a batch adds to known keys is as small as the repetition in it.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def written(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            rows.write.option("compression", "zstd").option("path", f"{shared_folder(self.spark).rstrip('/')}/{name}").partitionBy("fresh").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return name

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (high, low, doc_id), which holds all lines of its documents; repeated rows count once."""
        batch = lines.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
        runs = [name for level in self.levels for name in level]
        for i, name in enumerate(runs):
            batch = batch.join(self.spark.table(name).where("fresh").select(*KEY, F.lit(True).alias(f"in_{i}")), KEY, "left")
        known = F.coalesce(*[F.col(f"in_{i}") for i in range(len(runs))], F.lit(False))
        new = self.written(batch.select(*KEY, "n_docs", "last", (~known).alias("fresh")))
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.of(self.levels[level]).groupBy(*KEY, "fresh").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))
            new = self.written(merged.repartition(self.buckets, *KEY).select(*KEY, "n_docs", "last", "fresh"))
            self.drop(self.levels[level])
            self.levels[level] = []

    def of(self, names: list[str]) -> DataFrame:
        found = self.spark.table(names[0])
        for name in names[1:]:
            found = found.union(self.spark.table(name))
        return found

    def keys(self) -> DataFrame:
        """All keys: high, low, n_docs (documents that hold it) and last (the largest of their ids)."""
        return self.of([name for level in self.levels for name in level]).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def drop(self, names: list[str] | None = None) -> None:
        """Remove runs, all of them by default."""
        for name in [n for level in self.levels for n in level] if names is None else list(names):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(self.spark).rstrip('/')}/{name}")
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 8, fanout: int = 4) -> DataFrame:
    """Documents (doc_id, text) without the lines that at least least_docs documents hold; the one of the largest doc_id keeps them.

    A line's key is the line without outer blanks (space, tab, line feed, vertical tab, form feed, carriage return) and with A to Z lower-cased; keys of fewer code
    points than least_chars never go. Keys are told apart by 128 bits. Documents come in batches by a hash of doc_id; each
    batch is added to LineRuns. What the final runs say is joined with the lines again, the hot keys (at most 10,000) by a
    broadcast, all others by a shuffle in which none holds more than a ten-thousandth of the lines; the dropped keys of a
    document then meet its text.

    Null text is empty, and an empty text is one empty line. Rows of one doc_id are one document: each loses its lines by
    the same keys, and if that doc_id is the largest each keeps them. A null doc_id is one document below all others.
    Extra columns are ignored; an empty table gives no rows.

    Returns doc_id, text (kept lines joined by line feeds), n_lines (before), n_dropped.
    """
    spark = docs.sparkSession
    lines = stored(line_hashes(docs, least_chars, batches), "line-hashes", by=("batch",))
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    verdicts = stored(runs.keys().where(F.col("n_docs") >= least_docs), "line-verdicts")
    runs.drop()
    hot = F.col("n_docs") * HOT >= lines.count()
    lost = [lines.join(part, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", *KEY) for part in (F.broadcast(verdicts.where(hot)), verdicts.where(~hot))]
    of_document = lost[0].union(lost[1]).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct(*KEY)).alias("lost"))  # no more than the lines of one document

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, counts = [], []
            for text, keys in zip(encoded(frame["text"]), frame["lost"], strict=True):
                every = text.split(b"\n")
                if keys is None:
                    kept = every
                else:
                    gone = {np.array([k["high"], k["low"]], ">i8").tobytes() for k in keys}
                    kept = [line for line in every if line_key(line, least_chars) not in gone]
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                counts.append((len(every), len(every) - len(kept)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts, "n_lines": [n for n, _ in counts], "n_dropped": [d for _, d in counts]})

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(of_document, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    return map_frames(both, run, "doc_id long, text string, n_lines long, n_dropped long", SLICE_BYTES)
