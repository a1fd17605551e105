"""What each of five filters removes in every order: survivors of all subsets from one SQL cube, joined in pairs for each step."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import encoded, map_frames, stored

FILTERS = "ABCDE"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Words are counted in pieces of about so many bytes, so that long texts take no more memory than their different words.
PIECE = 1 << 20
SLICE_BYTES = 4 << 20


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and different words."""
    total, seen, begin = 0, set(), 0
    while begin < len(text):
        cut = BLANK.search(text, begin + PIECE)
        end = cut.start() if cut else len(text)
        found = text[begin:end].split()  # of bytes: at exactly these six blanks
        total += len(found)
        seen.update(found)
        begin = end
    return total, len(seen)


def failures(docs: DataFrame) -> DataFrame:
    """A row (doc_id, part, high, low, A, B, C, D) for each document: failure flags of the filters that look at one text, and 128 bits of a hash of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for raw in encoded(frame["text"]):
                total, distinct = word_counts(raw)
                chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))
                capitals = len(raw) - len(raw.translate(None, UPPER))
                digest = xxhash.xxh3_128_digest(raw)
                rows.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), total < 200, 100 * distinct < 50 * total, 100 * capitals > 3 * chars, len(raw) != len(raw.translate(None, SYMBOLS))))
            flags = pd.DataFrame(rows, columns=["high", "low", "A", "B", "C", "D"])
            yield pd.concat([frame[["doc_id", "part"]].reset_index(drop=True), flags], axis=1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return map_frames(rows, run, "doc_id long, part string, high long, low long, A boolean, B boolean, C boolean, D boolean", SLICE_BYTES)


def classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of each (part, A, B, C, D, E): n, good and toxic; at most 32 rows a part.

    E holds where a smaller doc_id has the same text. Copies are counted before they meet: of one text, what is
    left for each (part, labels) is a count, the least doc_id and how many rows have that one.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max((F.col("quality") == 1).cast("int")) == 1).alias("good"), (F.max((F.col("toxic") == 1).cast("int")) == 1).alias("toxic"))
    rows = failures(docs).join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    text, kind = ["high", "low"], ["part", "A", "B", "C", "D", "good", "toxic"]
    each = rows.groupBy("doc_id", *text, *kind).agg(F.count("*").alias("n"))
    copies = each.groupBy(*text, *kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = copies.groupBy(*text).agg(F.min("first.doc_id").alias("least"), F.collect_list(F.struct(*kind, "n", "nameless", "first")).alias("kinds"))  # at most 64 rows of one text and part
    one = least.select("least", F.explode("kinds").alias("k")).select("k.*", (F.col("k.nameless") + F.when(F.col("k.first.doc_id") == F.col("least"), F.col("k.first.n")).otherwise(0)).alias("alone"))
    split = one.select("*", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("alone").alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("alone")).alias("m")))).alias("e")).where(F.col("e.m") > 0)
    return split.groupBy("part", "A", "B", "C", "D", F.col("e.E").alias("E")).agg(F.sum("e.m").alias("n"), F.sum(F.when(F.col("good"), F.col("e.m")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("e.m")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters remove in each of their 120 orders, by part (lang, null as empty): a row for each part, order and step.

    A document (doc_id, text, lang) fails A below 200 words (maximal runs without ASCII blanks), B if under half of its words are
    different, C if over 3% of its code points are A to Z, D if it holds any of #$%&*|, E if a smaller doc_id has the same
    text, told by 128 bits. One cube over part and the flags counts documents for every subset of flags; rows whose flags are all
    false or summed over are the survivors of a subset. A step joins the survivors of the filters before it with those
    after it. labels (doc_id, quality, toxic) say which documents are good or toxic.

    Null text is empty; a null doc_id is neither smaller than another nor larger, and has no labels. Repeated rows count each, and rows of one doc_id do
    not fail E by each other. Of several labels of a document any 1 counts. Extra columns are ignored; an empty table gives no rows.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    spark = docs.sparkSession
    flags = list(FILTERS)
    every = ["".join(f for i, f in enumerate(FILTERS) if k >> i & 1) for k in range(2 ** len(FILTERS))]
    counts = ["n", "good", "toxic"]
    cubed = classes(docs, labels).cube("part", *flags).agg(*[F.sum(c).alias(c) for c in counts], *[F.grouping(f).alias(f"all_{f}") for f in ("part", *flags)])
    passed = cubed.where(F.col("all_part") == 0)
    for f in flags:
        passed = passed.where((F.col(f"all_{f}") == 1) | ~F.col(f))
    subset = F.concat(*[F.when(F.col(f"all_{f}") == 1, "").otherwise(f) for f in flags])
    survivors = passed.select("part", subset.alias("subset"), *counts)
    survivors = stored(survivors, "filter-survivors")
    parts = survivors.where(F.col("subset") == "").select("part", F.explode(F.array(*map(F.lit, every))).alias("subset"))
    whole = parts.join(survivors, ["part", "subset"], "left").fillna(0, counts)  # 32 rows a part
    written = lambda s: "".join(sorted(s))
    steps = spark.createDataFrame([("".join(o), i + 1, o[i], written(o[:i]), written(o[: i + 1]), written(set(FILTERS) - {o[i]})) for o in permutations(FILTERS) for i in range(len(FILTERS))], "filter_order string, step int, filter string, before string, after string, others string")
    at = lambda name: whole.select(F.col("part").alias("part"), F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in counts])
    row = F.broadcast(steps).join(at("before"), "before").join(at("after"), ["part", "after"])
    row = row.join(at("others").select("part", "others", "others_n"), ["part", "others"]).join(at("filter").select("part", "filter", "filter_n"), ["part", "filter"])
    row = row.join(at("none").where(F.col("none") == "").select("part", "none_n"), "part").join(at("all").where(F.col("all") == FILTERS).select("part", "all_n"), "part")
    removed = F.col("before_n") - F.col("after_n")
    row = row.select("*", removed.alias("removed"))
    shapley = row.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return row.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), "removed", (F.col("none_n") - F.col("filter_n") - F.col("removed")).alias("redundant"), (F.col("others_n") - F.col("all_n")).alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )
