"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import map_frames

BLANKS = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
MAX_SOURCES = 100_000
#: Blocks that are drawn at most, so that every draw is exact: beyond some 8 * 10**12 words blocks grow.
MAX_BLOCKS = 400_000_000
#: Slots of a shard that stay together, so that no task has to hold a whole shard.
CHUNK = 64


def targets(sizes: Sequence[int], weights: Sequence[float], limit: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, where none is above limit times its size and the excess goes to the others by weight."""
    out, active, left = [0.0] * len(sizes), [s for s, n in enumerate(sizes) if n], float(sum(sizes))
    while active:
        share = sum(weights[s] for s in active)
        over = [s for s in active if left * weights[s] / share > limit * sizes[s]]
        if not over:
            for s in active:
                out[s] = left * weights[s] / share
            break
        for s in over:
            out[s] = limit * sizes[s]
        left -= sum(out[s] for s in over)
        active = [s for s in active if s not in over]
    return out


def permuted(x: int, n: int, key: int) -> int:
    """Place of x in a permutation of range(n): a four-round Feistel network, walked until it falls within range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(4):
            f = (b * 0x9E3779B97F4A7C15 + key + r * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
            f ^= f >> 29
            f = f * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            a, b = b, a ^ (f >> 32 & mask)
        x = a << half | b
        if x < n:
            return x


class SplittingTree:
    """Quotas of blocks of each source, split in halves over shards: each half gets a multivariate-hypergeometric draw."""

    def __init__(self, quotas: Sequence[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self.node = lru_cache(maxsize=4096)(self._node)

    def _node(self, low: int, high: int) -> np.ndarray:
        """Blocks of each source that shards low to high get."""
        if (low, high) == (0, self.shards):
            return self.quotas
        a, b = 0, self.shards  # the parent, by walking down from the root
        while True:
            m = (a + b) // 2
            if (low, high) in ((a, m), (m, b)):
                break
            a, b = (a, m) if high <= m else (m, b)
        parent = self.node(a, b)
        draw = int(parent.sum()) * (m - a) // (b - a)
        random = np.random.Generator(np.random.PCG64([self.seed, a, b]))
        left, pool, want = np.zeros_like(parent), int(parent.sum()), draw
        for s, n in enumerate(parent):  # one hypergeometric draw per source, each given the earlier ones
            pool -= int(n)
            left[s] = hypergeometric(random, int(n), pool, want)
            want -= int(left[s])
        return left if high == m else parent - left

    def shard(self, source: int, place: int) -> tuple[int, int]:
        """The shard that gets the block at this place of the source's permuted order, and its place among the source's blocks there."""
        a, b = 0, self.shards
        while b - a > 1:
            m = (a + b) // 2
            left = int(self.node(a, m)[source])
            a, b, place = (a, m, place) if place < left else (m, b, place - left)
        return a, place


def hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not draws or not good:
        return 0
    if not bad:
        return draws
    return int(random.hypergeometric(good, bad, draws))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, limit: int = 3, block_words: int = 65_536, shard_blocks: int = 1024, seed: int = 7, carry: str = "") -> DataFrame:
    """Mix all documents (doc_id, text, source) so that each source's words come to its target.

    A document's size is its number of words (runs of other characters than blanks). Sources in order of code points,
    null last, weigh 1, 2, 3, repeating (or weights); targets share the words of all, none above limit times its
    source. Each source's stream of documents, in an order fixed by hashes, is cut into blocks of block_words words
    (smaller ones for a small source, larger ones where there would be more than MAX_BLOCKS). A target takes the whole stream as often as it fits; of the rest, whole blocks
    are drawn in a permuted order without repeats, and part of one more, so the words taken miss the target by less
    than one. Drawn blocks are dealt out over shards by the splitting tree, whose nodes any task works out from the
    seed, and take permuted slots within a shard: no draw is kept anywhere.

    Block counts and totals per source go to the driver (at most 100,000 sources, else an error); documents' words move
    nowhere, only doc_id, source and size, dealt out by source and hash bucket.
    Null or blank text has size 0 and is taken 0 words of; null or repeated doc_ids are mixed like others; equal rows
    may swap. Extra columns are ignored. An empty table gives no rows. Reruns give the same.

    Returns per document: doc_id, source, size, source_size, target, taken, pieces (copy, shard, slot, start, length),
    and the columns that carry names (DDL) as they are.
    """
    carried = [c.split()[0] for c in carry.split(",") if c]
    sized = docs.select("doc_id", "source", *carried, F.xxhash64("doc_id", "text").alias("h"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(BLANKS)).cast("long").alias("size"))
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = lambda *by: Window.partitionBy("source", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before(["bucket"])), F.lit(0)).alias("base"))
    rows = sums.groupBy("source").agg(F.sum("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r[0], int(r[1])) for r in rows), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be", "surrogatepass")))
    names, sizes = [s for s, _ in found], [n for _, n in found]
    weigh = [float(i % 3 + 1) if weights is None else float(weights.get(s, 1)) for i, s in enumerate(names)]
    aims = targets(sizes, weigh, limit)
    wholes = [min(limit, int(t // n)) if n else 0 for t, n in zip(aims, sizes, strict=True)]
    rests = [min(n, max(0, round(t - k * n))) if k < limit else 0 for t, n, k in zip(aims, sizes, wholes, strict=True)]
    block_words = max(block_words, limit * sum(sizes) // MAX_BLOCKS)
    unit = [max(1, min(block_words, n // 64)) for n in sizes]
    counts = [-(-n // u) for n, u in zip(sizes, unit, strict=True)]
    quotas = [k * c + -(-r // u) for k, c, r, u in zip(wholes, counts, rests, unit, strict=True)]
    shards = max(1, -(-sum(quotas) // shard_blocks))
    number = {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, slots = SplittingTree(quotas, shards, seed), lru_cache(maxsize=4096)(lambda shard: (int(tree.node(shard, shard + 1).sum()), np.concatenate([[0], np.cumsum(tree.node(shard, shard + 1))])))

        def slot(s: int, place: int) -> tuple[int, int]:
            shard, own = tree.shard(s, place)
            many, starts = slots(shard)
            return shard, permuted(int(starts[s]) + own, many, seed + shard)

        @lru_cache(maxsize=65_536)
        def block(s: int, b: int) -> tuple[list[tuple[int, int, int]], int]:
            """The block's (copy, shard, slot), and how many of its words the last, partial copy takes."""
            size = min(unit[s], sizes[s] - b * unit[s])
            out = [(c, *slot(s, c * counts[s] + permuted(b, counts[s], seed + 31 * s + c))) for c in range(wholes[s])]
            place = permuted(b, counts[s], seed + 31 * s + wholes[s])
            last = permuted_inverse_short(s)
            begins = place * unit[s] - (unit[s] - last[1] if place > last[0] else 0)
            more = max(0, min(size, rests[s] - begins))
            if more:
                out.append((wholes[s], *slot(s, wholes[s] * counts[s] + place)))
            return out, more

        @lru_cache(maxsize=None)
        def permuted_inverse_short(s: int) -> tuple[int, int]:
            """Place and words of the source's last block, which may be short."""
            b = counts[s] - 1
            return permuted(b, counts[s], seed + 31 * s + wholes[s]), sizes[s] - b * unit[s]

        for batch in batches:
            taken, pieces = [], []
            for source, size, at in zip(batch["source"], batch["size"], batch["at"], strict=True):
                s, own, done = number[source], [], 0
                while done < size:
                    b = (at + done) // unit[s]
                    inside = (at + done) - b * unit[s]
                    length = min(size - done, unit[s] - inside)
                    copies, more = block(s, b)
                    for c, shard, place in copies:
                        part = length if c < wholes[s] else max(0, min(length, more - inside))
                        if part:
                            own.append({"copy": c, "shard": shard, "slot": place, "start": done, "length": part})
                    done += length
                taken.append(sum(p["length"] for p in own))
                pieces.append(own)
            index = [number[s] for s in batch["source"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "size": batch["size"], "source_size": [sizes[i] for i in index], "target": [aims[i] for i in index], "taken": taken, "pieces": pieces, **{c: batch[c] for c in carried}})

    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.select("doc_id", "source", "size", *carried, (F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("at"))
    return map_frames(placed, run, "doc_id long, source string, size long, source_size long, target double, taken long, pieces array<struct<copy int, shard long, slot long, start long, length long>>" + (f", {carry}" if carry else ""))


def drawn(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself: docs (doc_id, text, source, lang, n_chars), a row for each part of a drawn block that one document fills, with these words as text; a text that one block takes whole stays as it is.

    Rows lie in the order of the deal: a partition holds runs of CHUNK slots of output shards, each block at its slot, so
    neither copies of a document nor blocks of a source stand together. Also returns shard and slot. Null, empty and blank
    texts are drawn nowhere; repeated rows are drawn like others; an empty table gives no rows.
    """
    word = re.compile(BLANKS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                spans = [m.span() for m in word.finditer(r.text)] if any(p["length"] < r.size for p in r.pieces) else []
                for p in r.pieces:
                    a, b = p["start"], p["start"] + p["length"]
                    text = r.text if b - a == r.size else r.text[spans[a][0] : spans[b - 1][1]]
                    out.append((r.doc_id, text, r.lang, r.source, len(text), p["shard"], p["slot"], a))
            yield pd.DataFrame(out, columns=["doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "start"], dtype=object)

    mixed = mix(docs, carry="text string, lang string", **how)
    rows = map_frames(mixed.where("taken > 0").select("doc_id", "text", "lang", "source", "size", "pieces"), cut, "doc_id long, text string, lang string, source string, n_chars long, shard long, slot long, start long")
    dealt = rows.withColumn("chunk", F.floor(F.col("slot") / CHUNK)).repartition("shard", "chunk")
    return dealt.sortWithinPartitions("shard", "slot", "doc_id", "start").drop("chunk", "start")
