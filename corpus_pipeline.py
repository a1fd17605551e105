"""Documents to training sequences: toxicity, near duplicates, secrets, mixture and packing, one stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import mixing, ngram_join, packing, secrets, toxicity
from periodica.llm.common import stored
from periodica.llm.queries import TOXIC_FROM, tokenizer_file

KIND = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = [c.split()[0] for c in KIND.split(", ")]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score below 0.3."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry="text string, lang string, source string, n_chars long")
    return scored.where(F.col("score") < TOXIC_FROM).select(COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others."""
    return ngram_join.one_of_each(docs.select(COLUMNS)).select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose texts a mark stands for each secret; n_chars follows the text where it changed."""
    clean = secrets.redact(docs.select(*COLUMNS, F.xxhash64("text").alias("before")))
    return clean.withColumn("n_chars", F.when(F.xxhash64("text") != F.col("before"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of all sources by their target weights: a row for each part of a drawn block, in the order in which blocks are dealt to shards and slots."""
    return mixing.drawn(docs).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    out = packing.pack(docs, tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
