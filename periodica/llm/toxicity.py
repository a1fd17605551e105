"""Toxicity of texts: votes of the nearest labelled examples by TF-IDF cosine, found exactly over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import freed, map_frames, stored

WORD = re.compile(r"[^\W\d_]+")
PREFIX = 5
CACHE_WORDS = 150_000
#: Postings of terms in more than 1 of so many examples are kept by block, with bounds; shorter ones are read whole.
LONG = 64
#: Postings of terms in more than 1 of so many examples are kept for all examples, as rows of a matrix.
COMMON = 8
#: So many texts are multiplied with that matrix at once.
TEXTS_AT_ONCE = 64
#: Texts are scored in frames of about so many bytes.
SLICE_BYTES = 4 << 20


def terms_of(word: str) -> list[str]:
    """A word in lower case counts as itself and as its first letters."""
    return [word, word[:PREFIX] + "*"] if len(word) > PREFIX else [word]


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))


class Vocabulary:
    """Numbers of the terms of a text, which are places in a sorted array of hashes; the words met so far keep theirs, -1 for an unknown one."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.slots: dict[str, int] = {}
        self.beginnings: dict[str, int] = {}
        self.pairs = np.full((CACHE_WORDS, 2), -1, np.int32)

    def learn(self, words: list[str]) -> None:
        begin = len(self.slots)
        if begin + len(words) > len(self.pairs):  # one text of very many words
            self.pairs = np.vstack([self.pairs, np.full((begin + len(words), 2), -1, np.int32)])
        if len(self.beginnings) > CACHE_WORDS:
            self.beginnings.clear()
        first = [w[:PREFIX] if len(w) > PREFIX else "" for w in words]
        self.beginnings.update((f, term_hash(f + "*")) for f in set(first) if f not in self.beginnings)
        wanted = np.array([list(map(term_hash, words)), list(map(self.beginnings.__getitem__, first))], np.uint64)
        place = np.searchsorted(self.hashes, wanted)
        known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == wanted if len(self.hashes) else np.zeros(wanted.shape, bool)
        self.pairs[begin : begin + len(words)] = np.where(known, place, -1).T
        self.slots.update(zip(words, range(begin, begin + len(words)), strict=True))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's known terms, rising, and how often each stands in it."""
        return self.counted(text)[:2]

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """As counts, and the text's words with the numbers of their terms, of whole words first and then of beginnings."""
        words = Counter(WORD.findall((text or "").lower()))
        if len(self.slots) + len(words) > CACHE_WORDS:
            self.slots.clear()
        self.learn([w for w in words if w not in self.slots])
        each = self.pairs[np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))].T.reshape(-1)
        known = each >= 0
        ids, place = np.unique(each[known], return_inverse=True)
        n = np.tile(np.fromiter(words.values(), np.int64, len(words)), 2)[known]
        return ids.astype(np.int64), np.bincount(place, n, len(ids)).astype(np.int64), each, list(words)


def named(ids: list[int], each: np.ndarray, words: list[str]) -> list[str]:
    """The terms of numbers ids, by what counted gives for a text."""
    places = [int(np.flatnonzero(each == i)[0]) for i in ids]
    return [words[p] if p < len(words) else words[p - len(words)][:PREFIX] + "*" for p in places]


@dataclass
class BlockIndex:
    """Postings of each term, by example. Terms with long lists also have, for each block of consecutive examples, where their postings begin and their largest weight there; the commonest, which no block lacks, have their weights for all examples in a row of a matrix instead."""

    size: int
    per_block: int
    row: np.ndarray
    common: np.ndarray
    begin: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    long: np.ndarray
    cells: np.ndarray
    top: np.ndarray

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, per_block: int) -> BlockIndex:
        n = len(vectors)
        example = np.repeat(np.arange(n), [len(i) for i, _ in vectors])
        term = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        order = np.lexsort((example, term))
        term, example, weight = term[order], example[order], weight[order]
        begin = np.searchsorted(term, np.arange(terms + 1))
        blocks = max(1, -(-n // per_block))
        everywhere = np.diff(begin) * COMMON > n
        row = np.where(everywhere, np.cumsum(everywhere) - 1, -1)
        common = np.zeros((int(everywhere.sum()), n))
        own = row[term] >= 0 if len(term) else np.zeros(0, bool)
        common[row[term[own]], example[own]] = weight[own]
        many = np.flatnonzero((np.diff(begin) * LONG > n) & ~everywhere)
        long = np.full(terms, -1)
        long[many] = np.arange(len(many))
        inside = long[term] >= 0 if len(term) else np.zeros(0, bool)
        cell = long[term[inside]] * blocks + example[inside] // per_block
        places = np.flatnonzero(inside)
        ends = np.searchsorted(cell, np.arange(len(many) * blocks + 1))
        cells = np.append(places, 0)[np.minimum(ends, len(places))] if len(many) else np.zeros(1, np.int64)
        counts = np.diff(ends)
        top = np.zeros(len(many) * blocks)
        np.maximum.at(top, cell, weight[inside])
        return cls(n, per_block, row.astype(np.int32), common, begin, example, weight, long.astype(np.int32), np.stack([cells[:-1], counts]).astype(np.int32), np.nextafter(top.reshape(-1, blocks), 2))  # bounds are never below

    def scored(self, weights: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sums over runs of postings, one weight for each run."""
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - count), count)
        return np.bincount(self.example[at], np.repeat(weights, count) * self.weight[at], self.size)

    def blocks_scored(self, rows: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        cells = (rows[:, None] * self.top.shape[1] + blocks[None, :]).reshape(-1)
        return self.scored(np.repeat(weights, len(blocks)), self.cells[0, cells], self.cells[1, cells])

    def commonest(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the commonest terms give to the cosines of texts (rows) and all examples (columns)."""
        parts = np.zeros((len(vectors), len(self.common)))
        for part, (ids, weights) in zip(parts, vectors, strict=True):
            row = self.row[ids]
            part[row[row >= 0]] = weights[row >= 0]
        return parts @ self.common

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine over 0 and their cosines to 12 places, ties to the earlier.

        What the commonest terms give is added up for all examples (given, if worked out before), and short lists are read
        whole. Of long lists only blocks are read whose bound, with what those gave, reaches the k-th best found in the
        most promising blocks; where most stay open, whole lists are read, with the same result.
        """
        given = self.commonest([(ids, weights)])[0] if given is None else given
        rare = self.row[ids] < 0
        ids, weights = ids[rare], weights[rare]
        row = self.long[ids]
        short, far = row < 0, row >= 0
        low = self.begin[ids]
        count = self.begin[ids + 1] - low
        scores = given + self.scored(weights[short], low[short], count[short])
        if far.any():
            blocks = self.top.shape[1]
            padded = np.zeros(blocks * self.per_block)
            padded[: self.size] = scores
            bound = weights[far] @ self.top[row[far]] + padded.reshape(blocks, -1).max(axis=1)
            first = -(-2 * k // self.per_block)
            best = np.argpartition(-bound, first)[:first] if blocks > first else np.arange(blocks)
            part = scores + self.blocks_scored(row[far], weights[far], best)
            inside = (best[:, None] * self.per_block + np.arange(self.per_block)).reshape(-1)
            inside = inside[inside < self.size]
            least = np.partition(part[inside], len(inside) - k)[len(inside) - k] if len(inside) > k else 0.0
            open_ = bound >= max(least * (1 - 1e-9), 1e-12)
            open_[best] = False
            if open_.sum() * 2 > blocks:
                scores = scores + self.scored(weights[far], low[far], count[far])
            else:
                scores = part + self.blocks_scored(row[far], weights[far], np.flatnonzero(open_)) if open_.any() else part
                closed = np.repeat(~open_, self.per_block)[: self.size]
                closed[inside] = False
                scores[closed] = 0.0  # below the k-th best, and not read to the end
        scores = scores.round(12)
        found = np.flatnonzero(scores > 1e-12)
        if len(found) > 4 * k:
            found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((found, -scores[found]))][:k]
        return found, scores[found]


def isotonic(x: np.ndarray, y: np.ndarray, shrink: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the best rising curve. Each pool counts shrink more points of the mean of y, so that pools of few points say less; what that lets fall is held level."""
    points, inverse = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for value, total, n in zip(points, np.bincount(inverse, y), np.bincount(inverse), strict=True):
        pools.append([value, value, total, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            low, _, t, m = pools[-2]
            pools[-2:] = [[low, pools[-1][1], t + pools[-1][2], m + pools[-1][3]]]
    rates = np.maximum.accumulate(np.array([(t + shrink * y.mean()) / (n + shrink) for *_, t, n in pools for _ in range(2)]))
    return np.array([p for low, high, *_ in pools for p in (low, high)]), rates


def term_weights(ids: list[np.ndarray], labels: np.ndarray, terms: int, floor: float) -> np.ndarray:
    """Weight of each term by the examples given: inverse document frequency times a factor from floor to 1 by how much more often than by chance, and a standard deviation more, toxic ones have it: a word of one toxic example alone is no sign."""
    count = lambda lists: np.bincount(np.concatenate([np.zeros(0, np.int64), *lists]), minlength=terms)
    seen, toxic = count(ids), count([i for i, y in zip(ids, labels, strict=True) if y])
    rate = labels.mean() if len(labels) else 0.0
    lean = np.maximum(0, (toxic - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1) - 1)
    return (np.log(max(len(labels), 1) / np.maximum(seen, 1)) + 1) * (floor + (1 - floor) * lean / max(lean.max(initial=0), 1e-9))


@dataclass
class Model:
    """Hashes of terms in order and their weights, the index over examples, their labels and ids, the calibration, and the rate among examples without any word."""

    hashes: np.ndarray
    term_weight: np.ndarray
    index: BlockIndex
    labels: np.ndarray
    ids: list[int | None]
    knots: tuple[np.ndarray, np.ndarray]
    bare_rate: float
    neighbours: int

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.term_weight[ids]
        return ids, weights / np.sqrt(weights @ weights) if len(ids) else weights

    def vote(self, ids: np.ndarray, weights: np.ndarray, given: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Share of toxic ones among the nearest examples, weighted by the square of their cosine."""
        if not len(ids) or not self.index.size:
            return -1.0, np.zeros(0, int)
        found, cosine = self.index.nearest(ids, weights, self.neighbours, given)
        return float(cosine**2 @ self.labels[found] / (cosine @ cosine)) if len(found) else -1.0, found

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text calibrated probability, examples nearest first, and the text's terms by weight."""
        for at in range(0, len(counted), TEXTS_AT_ONCE):
            vectors = [self.vector(*c) for c in counted[at : at + TEXTS_AT_ONCE]]
            for (ids, weights), given in zip(vectors, self.index.commonest(vectors), strict=True):
                vote, found = self.vote(ids, weights, given)
                rate = self.bare_rate if vote < 0 else float(np.interp(vote, *self.knots))
                yield min(1.0, max(0.0, rate)), found, ids[np.argsort(-weights, kind="stable")]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int, floor: float, neighbours: int, per_block: int, folds: int, shrink: float) -> Model:
    """A model from at most max_examples labelled documents outside the held-out quarter, the first in the order of a hash of their ids."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").alias("is_toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # bounded, so it may be broadcast
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    examples = stored(named.groupBy("doc_id", "is_toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "toxicity-examples")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            for text in batch["text"]:
                seen.update(t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w))
        yield pd.DataFrame({"term": list(seen)})

    hashes = np.unique(np.array([term_hash(t) for t in map_frames(examples, met, "term string").distinct().toArrow().column("term").to_pylist()], np.uint64))  # terms of the bounded sample
    shared_terms = spark.sparkContext.broadcast(hashes)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(shared_terms.value)
        for batch in batches:
            counts = [vocabulary.counts(t) for t in batch["text"]]
            yield batch[["doc_id", "is_toxic", "fold"]].assign(ids=[i for i, _ in counts], n=[n for _, n in counts])

    with_fold = examples.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int"))
    counted = stored(map_frames(with_fold, coded, "doc_id long, is_toxic int, fold int, ids array<int>, n array<int>", SLICE_BYTES), "toxicity-terms")
    rows = counted.toArrow().to_pandas(integer_object_nulls=True)  # at most max_examples
    shared_terms.destroy()
    rate = float(rows["is_toxic"].mean()) if len(rows) else 0.0
    bare = rows.loc[rows["ids"].map(len) == 0, "is_toxic"].to_numpy()
    rows = rows[rows["ids"].map(len) > 0]
    leading = np.array([i[n.argmax()] for i, n in zip(rows["ids"], rows["n"], strict=True)], np.int64)  # alike texts stand in the same blocks
    rows = rows.iloc[np.lexsort((rows["doc_id"].to_numpy().astype(np.int64), leading, rows["is_toxic"].to_numpy().astype(np.int64)))] if len(rows) else rows
    bare_rate = (bare.sum() + rate) / (len(bare) + 1)

    def model_of(part: pd.DataFrame) -> Model:
        ids, toxic = [i.astype(np.int64) for i in part["ids"]], part["is_toxic"].to_numpy().astype(float)
        model = Model(hashes, term_weights(ids, toxic, len(hashes), floor), BlockIndex.build([], len(hashes), per_block), toxic, part["doc_id"].tolist(), (np.zeros(1), np.array([rate])), bare_rate, neighbours)
        model.index = BlockIndex.build([model.vector(i, n) for i, n in zip(ids, part["n"], strict=True)], len(hashes), per_block)
        return model

    votes = []
    for fold in range(folds):
        shared = spark.sparkContext.broadcast(model_of(rows[rows["fold"] != fold]))

        def voted(batches: Iterator[pd.DataFrame], shared: Broadcast = shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                vote = [shared.value.vote(*shared.value.vector(i.astype(np.int64), n))[0] for i, n in zip(batch["ids"], batch["n"], strict=True)]
                yield pd.DataFrame({"vote": vote, "toxic": batch["is_toxic"].astype(float)})

        votes.append(map_frames(counted.where(F.col("fold") == fold).repartition(spark.sparkContext.defaultParallelism), voted, "vote double, toxic double").toArrow().to_pandas())
        shared.destroy()
    freed(examples, counted)
    vote = pd.concat(votes)
    vote = vote[vote["vote"] >= 0]
    model = model_of(rows)
    return replace(model, knots=isotonic(vote["vote"].to_numpy(), vote["toxic"].to_numpy(), shrink)) if len(vote) else model


def score(docs: DataFrame, labels: DataFrame, max_examples: int = 4000, floor: float = 0.05, neighbours: int = 32, per_block: int = 32, folds: int = 5, shrink: float = 4.0, carry: str = "") -> DataFrame:
    """Probability that each document (doc_id, text) would be marked in labels (doc_id, toxic).

    Labelled examples are a bounded sample: at most max_examples labelled documents whose crc32 of doc_id modulo 4 is not
    2, first in the order of a hash of doc_id. Terms are words and their first 5 letters; all terms of the sample span the
    TF-IDF space. A term's weight is its idf in the sample times a factor from floor to 1 that rises with how much more often than by
    chance toxic examples have it (standardized, less 1, over the largest of all terms): no term is left out, but those that speak
    of the class weigh most. Terms that no example has change no order of cosines and no vote. Nearest examples
    are exact: a block of examples is skipped only if its bound lies below the k-th best. Votes weigh the squared
    cosine and are calibrated by isotonic regression on votes of the examples: of each fold (by a hash of doc_id) by a model
    of the other folds, weights of terms and all, so that no example's label speaks for itself; shrink more examples of the mean rate in each
    pool keep small samples from sharp steps. Index and vocabulary are bounded by the sample and broadcast; all documents are scored by whole text where they lie.

    Null text is empty. Texts without any of the terms get the (smoothed) rate of such examples; without any labels 0.
    Labels other than 0 and 1 are ignored, of contradicting ones the largest counts. Repeated doc_ids keep a row each, and the
    text of the least hash among them is the example. Extra columns are ignored; an empty table gives no rows.

    Returns doc_id, held_out, score, neighbours (ids of the nearest examples), terms (up to 8 that weigh most), and the
    columns that carry names (DDL) as they are.
    """
    model = fit(docs, labels, max_examples, floor, neighbours, per_block, folds, shrink)
    names = [c.split()[0] for c in carry.split(",") if c]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        vocabulary = Vocabulary(m.hashes)
        for batch in batches:
            out, terms = [], []
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                counted = [vocabulary.counted(t) for t in batch["text"].iloc[at : at + TEXTS_AT_ONCE]]
                out.extend(m.scores([c[:2] for c in counted]))
                terms.extend(named(o[2][:8].tolist(), *c[2:]) for o, c in zip(out[at:], counted, strict=True))
            kept = {c: batch[c] for c in names}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [s for s, _, _ in out], "neighbours": [[m.ids[i] for i in f.tolist()] for _, f, _ in out], "terms": terms, **kept})

    columns = ["doc_id", *dict.fromkeys(["text", *names])]
    scored = map_frames(docs.select(columns), run, "doc_id long, score double, neighbours array<long>, terms array<string>" + (f", {carry}" if carry else ""), SLICE_BYTES)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "neighbours", "terms", *names)
