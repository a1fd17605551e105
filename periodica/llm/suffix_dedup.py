"""Suffix-array dedup: remove bytes of passages that also start in an earlier document.

Positions where a shared passage must have an anchor are picked by content, so only suffixes at anchors that several
documents have are sorted: by deep-shallow sorting, to the right of the anchor and to its left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import freed, in_groups, map_frames, mix64, powers, stored
from periodica.llm.deep_shallow import sort
from periodica.llm.shared_hashes import packed_texts, second_hash, shared_places, sliding

GRAM = 20
#: Slices of one anchor that a task sorts at most.
HOT = 20_000
#: Slices that a task hands on together.
ROWS_AT_ONCE = 50_000
#: Anchors are judged in so many parts, one after another, so that less is shuffled at a time.
PASSES = 2
#: Ids that stand in for missing ones, and sort after all others.
LAST = (1 << 63) - 1


def gram_hashes(texts: list[bytes]) -> np.ndarray:
    """Hash of every run of GRAM bytes of the texts, one behind the other."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    if len(buffer) < GRAM:
        return np.zeros(0, np.uint64)
    up, down = powers(len(buffer) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix64((sums[GRAM:] - sums[:-GRAM]) * down[: len(buffer) - GRAM + 1])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of every run of GRAM bytes whose hash is the least in some run of length bytes: equal runs of length bytes have equal anchors, wherever they stand."""
    window = length - GRAM + 1
    ends = np.cumsum([len(t) for t in texts])
    hashes = gram_hashes(texts)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding(hashes, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(hashes == sliding(np.concatenate([edge, least, edge]), window, np.maximum))
    text = np.searchsorted(ends, at, "right")
    begins = ends - np.array([len(t) for t in texts])
    whole = (at + GRAM <= ends[text]) & (ends[text] - begins[text] >= length)
    at, text = at[whole], text[whole]
    return hashes[at], text, at - begins[text]


def starts(hashes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the runs of length bytes, within one text, whose least hash is the one at each place (last before first if none)."""
    reach, n = length - GRAM, len(hashes)
    offsets = np.arange(1, reach + 1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.concatenate([np.full(reach, none), hashes, np.full(reach, none)])
    own = hashes[at][:, None]
    left = padded[at[:, None] + reach - offsets] < own
    right = padded[at[:, None] + reach + offsets] < own
    before = np.where(left.any(axis=1), left.argmax(axis=1), reach)
    after = np.where(right.any(axis=1), right.argmax(axis=1), reach)
    return np.maximum(at - before, 0), np.minimum(np.minimum(at, at + after - reach), n - 1 - reach)


def slices(docs: DataFrame, shared: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """What stands around each shared anchor: (slice, other, rank, doc, text_hash, place, left, right), for the first document of each text; left is reversed, and both reach as far as runs go of which the anchor is the least: each run is judged at one anchor, the same in all texts. slice and other, two hashes, tell pairs of left and right apart."""

    columns = ["rank", "doc", "text_hash", "place", "left", "right"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for rank, doc, text_hash, packed, places in zip(batch["rank"], batch["doc"], batch["text_hash"], batch["packed"], batch["places"], strict=True):
                text = unpack.decompress(packed)
                at = np.unique(np.concatenate(list(places))).astype(np.int64)
                at = at[at <= len(text) - GRAM]
                first, last = starts(gram_hashes([text]), at, length)
                for p, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                    if a <= b:
                        rows.append((rank, doc, text_hash, p, text[a:p][::-1], text[p : b + length]))
                if len(rows) > ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    gathered = shared.groupBy("doc").agg(F.collect_list("places").alias("places")).join(first, "doc")
    packed = packed_texts(docs).join(gathered, ["doc", "text_hash"]).where("rank = first").dropDuplicates(["rank", "doc", "text_hash"]).select("rank", "doc", "text_hash", "packed", "places")  # by the keys of the join, so that texts are shuffled once
    rows = map_frames(packed, cut, "rank long, doc long, text_hash long, place int, left binary, right binary")
    return rows.select(F.xxhash64("left", "right").alias("slice"), F.xxhash64("right", F.lit(1), "left").alias("other"), "rank", "doc", "text_hash", "place", "left", "right")


def matrix(parts: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows filled up with zeros, and their lengths."""
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width), np.array([len(p) for p in parts])


def verdicts(distinct: DataFrame, length: int) -> DataFrame:
    """(slice, other, runs): for each distinct slice, runs of window starts before the anchor (from, to) that also stand in a document of rank first."""
    reach = length - GRAM

    def judge(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        rank = frame["rank"].to_numpy().astype(np.int64)
        right, right_size = matrix(frame["right"], length)
        left, left_size = matrix(frame["left"], reach)
        m = len(frame)
        first = np.full((reach + 1, m), LAST)
        alone = np.diff(cuts)[group] == 1
        fits = lambda j: (left_size >= j) & (right_size >= length - j)
        for j in range(reach + 1):
            first[j, alone & fits(j)] = rank[alone & fits(j)]
        some = np.flatnonzero(~alone)
        if len(some):
            place_right, shared_right = sort(group[some], right[some])
            place_left, shared_left = sort(group[some], left[some])
            by_right, by_left = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
            for j in range(reach + 1):
                ok = np.flatnonzero(fits(j)[some])
                if len(ok) == 0:
                    continue
                by_right[place_right] = np.cumsum(shared_right < length - j)
                by_left[place_left] = np.cumsum(shared_left < j)
                order = ok[np.lexsort((by_left[ok], by_right[ok]))]
                new = np.concatenate([[True], (by_right[order[1:]] != by_right[order[:-1]]) | (by_left[order[1:]] != by_left[order[:-1]])])
                least = np.minimum.reduceat(rank[some][order], np.flatnonzero(new))
                first[j, some[order]] = least[np.cumsum(new) - 1]
        padded = np.vstack([np.full((1, m), -1), first])
        change = padded[1:] != padded[:-1]
        runs = []
        column, row = np.nonzero(change.T)
        bounds = np.searchsorted(column, np.arange(m + 1))
        for i in range(m):
            begin = row[bounds[i] : bounds[i + 1]]
            end = np.append(begin[1:], reach + 1) - 1
            runs.append([{"low": int(a), "high": int(b), "first": int(first[a, i])} for a, b in zip(begin, end, strict=True) if first[a, i] != LAST])
        return pd.DataFrame({"slice": frame["slice"], "other": frame["other"], "runs": runs})

    return in_groups(distinct, ["gram"], judge, "slice long, other long, runs array<struct<low int, high int, first long>>")


def hot_verdicts(distinct: DataFrame, length: int) -> DataFrame:
    """As verdicts, for anchors with so many different slices that no task should hold them: each run of length bytes over the anchor stands for itself, and the least rank of each is an aggregation."""
    reach = length - GRAM
    fits = F.filter(F.sequence(F.lit(0), F.lit(reach)), lambda j: (F.octet_length("left") >= j) & (F.octet_length("right") >= length - j))
    each = distinct.select("slice", "other", "rank", F.explode(fits).alias("j"), "left", "right")
    run = F.concat(F.hex(F.expr("substring(left, 1, j)")), F.lit(":"), F.hex(F.expr(f"substring(right, 1, {length} - j)")))
    each = each.select("slice", "other", "rank", "j", F.md5(run).alias("run"))
    first = each.groupBy("j", "run").agg(F.min("rank").alias("first"))
    met = each.join(first, ["j", "run"]).select("slice", "other", F.struct(F.col("j").alias("low"), F.col("j").alias("high"), "first").alias("run"))
    return met.groupBy("slice", "other").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def judgements(around: DataFrame, length: int) -> list[DataFrame]:
    """(slice, other, runs) of all slices with a run that also stands in another document, a table for each part of the anchors."""
    gram = F.xxhash64(F.substring("right", 1, GRAM))
    out = []
    for part in range(PASSES):
        own = around.where(F.pmod(gram, F.lit(PASSES)) == part)
        distinct = stored(own.groupBy("slice", "other").agg(F.min("rank").alias("rank"), F.first("left").alias("left"), F.first("right").alias("right")).withColumn("gram", gram), "suffix-distinct")
        many = distinct.groupBy("gram").count().where(F.col("count") > HOT).select("gram")
        judged = verdicts(distinct.join(many, "gram", "left_anti"), length)
        if many.take(1):
            judged = judged.union(hot_verdicts(distinct.join(many, "gram"), length))
        out.append(stored(judged.where(F.exists("runs", lambda r: r["first"] < LAST)), "suffix-verdicts"))
        freed(distinct)
    return out


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Cut from each document (doc_id, text) all bytes covered by a run of length bytes that also starts in a document with a smaller doc_id.

    Texts count as UTF-8 bytes and are taken whole; runs never cross documents; overlaps count, and all runs are judged on
    the input. Of equal texts (by 124 bits of two hashes) only the first is looked into; all others are repeats as a whole. Work is spread by anchor hashes, distinct contexts and documents; contexts that many documents share are reduced to one
    with their smallest doc_id before they meet, so no task gathers all occurrences of a passage. An anchor with more than HOT
    different contexts is judged by an aggregation over its runs instead of by sorting.

    Null text is empty. Rows with one and the same doc_id never cut each other. Rows without doc_id count as last: they
    lose what any numbered row has, and cut nothing. Extra columns are ignored; an empty table gives no rows.

    Returns doc_id, n_bytes, spans (maximal removed runs: start, end in bytes), kept (remaining bytes, binary).
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", "text", second_hash(text).alias("text_hash"), F.xxhash64(text).alias("doc"), F.coalesce("doc_id", F.lit(LAST)).alias("rank"))
    first = stored(named.groupBy("doc", "text_hash").agg(F.min("rank").alias("first")), "suffix-texts")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = shared_places(named, lambda texts: anchors(texts, length), int(size * 2 / (length - GRAM + 2)))
    around = stored(slices(named, shared, first, length), "suffix-slices")
    freed(shared)
    judged = judgements(around, length)
    places = around.select("slice", "other", "rank", "doc", "text_hash", "place").join(reduce(DataFrame.union, judged), ["slice", "other"])
    hit = F.filter("runs", lambda r: r["first"] < F.col("rank"))
    cut = places.select("doc", "text_hash", F.explode(F.transform(hit, lambda r: F.struct((F.col("place") - r["high"]).alias("start"), (F.col("place") - r["low"] + length).alias("end")))).alias("span"))
    removed = stored(first.join(cut.groupBy("doc", "text_hash").agg(F.collect_set("span").alias("spans")), ["doc", "text_hash"], "left"), "suffix-removed")
    freed(first, around, *judged)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, packed, later, spans in zip(batch["doc_id"], batch["packed"], batch["later"], batch["spans"], strict=True):
                text, merged, kept, done = unpack.decompress(packed), [], [], 0
                found = sorted((s["start"], s["end"]) for s in spans) if spans is not None else []
                for a, b in [(0, len(text))] if later and len(text) >= length else found:
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], b)
                    else:
                        merged.append({"start": a, "end": b})
                for s in merged:
                    kept.append(text[done : s["start"]])
                    done = s["end"]
                out.append((doc_id, len(text), merged, b"".join([*kept, text[done:]])))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"], dtype=object)

    texts = packed_texts(named).join(removed, ["doc", "text_hash"]).withColumn("later", F.col("rank") > F.col("first"))
    return map_frames(texts.select("doc_id", "packed", "later", "spans"), keep, "doc_id long, n_bytes long, spans array<struct<start int, end int>>, kept binary")
