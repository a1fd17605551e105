"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import map_frames, stored

CACHE_PARTS = 200_000
TEXTS_AT_ONCE = 512
#: Sources that a mixture may have; their totals go to the driver and to every task.
MAX_QUEUES = 100_000
#: Cells (windows times queues) of a segment at most, and of all segments and of all first tokens that a task keeps.
SEGMENT_CELLS, KEPT_CELLS = 1 << 16, 1 << 22
#: Characters that str.split takes for blanks and the tokenizer does not, and the start of special tokens.
UNUSUAL = re.compile("[\x1c-\x1f]|<\\|")


#: Texts and words of which lower case and parts are the same by character as in the tokenizer: no apostrophes, which begin contractions.
SIMPLE_TEXT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~ \t\n\r\x0b\x0c]*")
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
WORD_END = "</w>"
JOINED_PARTS = 20_000


class WordIds(dict):
    """Ids of parts of texts, as little-endian 16-bit numbers.

    The tokenizer cuts texts into parts (letters, single digits, other signs) whose ids do not depend on their
    neighbours; new parts are handed to it many at a time, and told apart by the ids that end a part. Words of other
    characters are handed over whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.whole(word)
        return ids

    def learn(self, parts: list[str]) -> None:
        """Take in simple parts that are not known yet."""
        for low in range(0, len(parts), JOINED_PARTS):
            some = parts[low : low + JOINED_PARTS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                coded, bounds = ids.tobytes(), [0, *(2 * last).tolist()]
                self.update((p, coded[a:b]) for p, a, b in zip(some, bounds, bounds[1:]))
            else:
                self.update((p, self.whole(p)) for p in some)

    def cut(self, text: str) -> list[str]:
        """Parts of simple words, and other words as they are."""
        if SIMPLE_TEXT.fullmatch(text):
            return PARTS.findall(text.lower())
        out: list[str] = []
        for word in text.split():
            out += PARTS.findall(word.lower()) if SIMPLE.fullmatch(word) else [word]
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE_PARTS:
            self.clear()
        odd = [bool(UNUSUAL.search(t)) for t in texts]
        cut = [[] if o else self.cut(t) for t, o in zip(texts, odd, strict=True)]
        self.learn([p for p in set().union(*cut).difference(self) if SIMPLE.fullmatch(p)])
        return [self.whole(t) if o else b"".join(map(self.__getitem__, parts)) for t, o, parts in zip(texts, odd, cut, strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of each document with end_id after them, and where they begin among those of the same source and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, end = word_ids(tokenizer_path), np.array([end_id], "<u2").tobytes()
        task, begun = TaskContext.get().partitionId(), {}
        for batch in batches:
            coded = [c + end for low in range(0, len(batch), TEXTS_AT_ONCE) for c in ids.texts([t if isinstance(t, str) else "" for t in batch["text"].iloc[low : low + TEXTS_AT_ONCE]])]
            sizes = [len(c) // 2 for c in coded]
            starts = []
            for source, size in zip(batch["source_key"], sizes, strict=True):
                starts.append(begun.get(source, 0))
                begun[source] = starts[-1] + size
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source_key": batch["source_key"], "task": task, "begun": starts, "n": sizes, "ids": coded})

    columns = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"), "text")
    return map_frames(columns, run, "doc_id long, source_key string, task long, begun long, n long, ids binary")


def taken_by(volume: int, totals: Sequence[int], weights: Sequence[float]) -> list[int]:
    """Tokens that each queue has given after volume tokens in all: by weight, until queues run empty one after another."""
    left, given, active = float(volume), [0.0] * len(totals), {s for s, t in enumerate(totals) if t}
    while active and left > 1e-9:
        share = sum(weights[s] for s in active)
        step = min([left / share, *((totals[s] - given[s]) / weights[s] for s in active)])
        for s in active:
            given[s] += step * weights[s]
        left -= step * share
        active = {s for s in active if totals[s] - given[s] > 1e-6}
    return [min(t, int(g + 1e-6)) for t, g in zip(totals, given, strict=True)]


def round_robin(amounts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Deficit round-robin over one segment of the stream.

    amounts: tokens of each queue. Windows hold length tokens; the rest of the segment makes windows of powers of two.
    Each window adds its share to every queue's deficit counter; a queue gives the whole tokens of its counter, the
    largest remainders fill the window, and what is not given is carried on. Returns, per window and queue, the tokens
    given before (one row more than windows) and the offset in the window.
    """
    total = int(amounts.sum())
    sizes = [length] * (total // length) + [1 << k for k in range(length.bit_length(), -1, -1) if total % length >> k & 1]
    left, deficit = amounts.astype(np.int64).copy(), np.zeros(len(amounts))
    share, gives = amounts / max(total, 1), np.zeros((len(sizes), len(amounts)), np.int64)
    for w, size in enumerate(sizes):
        deficit += size * share
        give = np.clip(np.floor(deficit + 1e-9).astype(np.int64), 0, left)
        rest = size - int(give.sum())
        while rest:
            order = np.argsort(-(deficit - give), kind="stable")
            if rest > 0:
                order = order[left[order] > give[order]][:rest]
                give[order] += 1
                rest -= len(order)
            else:
                order = order[give[order] > 0][rest:]
                give[order] -= 1
                rest += len(order)
        deficit -= give
        left -= give
        gives[w] = give
    before = np.concatenate([np.zeros((1, len(amounts)), np.int64), np.cumsum(gives, axis=0)])
    return before, np.cumsum(gives, axis=1) - gives


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = 4096, end_id: int = 2, weights: dict[str | None, float] | None = None, segment_windows: int = 1024) -> DataFrame:
    """Pack all documents (doc_id, text, source) into sequences of sequence_length tokens, each mixing its sources in target proportions.

    The token stream of every source is a queue; deficit round-robin fills each window, carrying deficits from window
    to window. Target proportions are the sources' own token shares, or weights (a source without one counts 1); a queue that
    runs empty leaves its share to the others. The stream is cut into segments of segment_windows windows whose first
    token of each queue has a closed form, so deficits carry across segments too and tasks fill their windows without
    waiting for each other. A segment's last tokens make sequences of powers of two, so none needs padding.

    Ids are written once to the shared folder and never shuffled. Only totals per task and source move. Segments
    are shorter where there are many sources; more than 100,000 are an error. Null text is empty: it gives end_id alone. A null source is a source of its own.
    Null or repeated doc_ids are packed like others; extra columns are ignored; an empty table gives no rows.

    Returns per piece: doc_id, source_key, start, length, ids (binary, unsigned 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset.
    """
    if sequence_length & (sequence_length - 1):
        raise ValueError("sequence_length must be a power of two")
    coded = stored(tokenized(docs, tokenizer_path, end_id), "pack-ids")
    parts = coded.groupBy("source_key", "task").agg(F.sum("n").alias("n"))
    sources = [r[0] for r in parts.select("source_key").distinct().orderBy("source_key").limit(MAX_QUEUES + 1).collect()]
    if len(sources) > MAX_QUEUES:
        raise ValueError(f"more than {MAX_QUEUES} sources")
    numbers = docs.sparkSession.createDataFrame(list(enumerate(sources)), "queue long, source_key string")
    parts = parts.join(F.broadcast(numbers), "source_key")  # at most MAX_QUEUES rows
    before = Window.partitionBy("queue").orderBy("task", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("source_key", "task", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sums = {r[0]: int(r[1]) for r in parts.groupBy("queue").agg(F.sum("n")).collect()}  # at most MAX_QUEUES rows
    totals = [sums.get(q, 0) for q in range(max(sums, default=-1) + 1)]
    shares = [float(t) for t in totals]
    if weights is not None:
        shares = [float(weights.get(s[1:] if s[0] == "s" else None, 1)) for s in sources]
        if min(shares, default=1) <= 0:
            raise ValueError("weights must be positive")
    total = sum(totals)
    segment_windows = max(1, min(segment_windows, SEGMENT_CELLS // max(1, len(totals))))
    segments = max(1, -(-total // (segment_windows * sequence_length)))
    natural = weights is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=max(64, KEPT_CELLS // max(1, len(totals))))
        def first(p: int) -> list[int]:
            if natural or p == segments:
                return [t * p // segments for t in totals]
            return taken_by(total * p // segments, totals, shares)

        @lru_cache(maxsize=max(4, KEPT_CELLS // (segment_windows * max(1, len(totals)))))
        def filled(p: int) -> tuple[np.ndarray, np.ndarray]:
            return round_robin(np.array(first(p + 1)) - np.array(first(p)), sequence_length)

        def segment_of(position: int, q: int) -> int:
            return bisect.bisect_right(range(segments), position, key=lambda p: first(p)[q]) - 1

        for batch in batches:
            rows: list[tuple] = []
            for doc, key, n, at, q, coded in zip(batch["doc_id"], batch["source_key"], batch["n"], batch["at"], batch["queue"], batch["ids"], strict=True):
                ids = np.frombuffer(coded, "<u2").astype("<u4").tobytes()
                done, p = 0, segment_of(at, q)
                while done < n:
                    while first(p + 1)[q] <= at + done:
                        p += 1
                    given, offsets = filled(p)
                    column = given[:, q]
                    here = at + done - first(p)[q]
                    w = int(np.searchsorted(column, here, "right")) - 1
                    length = int(min(n - done, column[w + 1] - here))
                    piece = ids[4 * done : 4 * (done + length)]
                    rows.append((doc, key, done, length, piece, zlib.crc32(piece), n, (p << 24) + w, int(offsets[w, q] + here - column[w])))
                    done += length
            yield pd.DataFrame(rows, columns=["doc_id", "source_key", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"], dtype=object)

    placed = coded.join(base, ["source_key", "task"]).select("doc_id", "source_key", "n", (F.col("begun") + F.col("base")).alias("at"), "queue", "ids")
    return map_frames(placed, run, "doc_id long, source_key string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
