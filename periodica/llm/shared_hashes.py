"""Places in texts whose hash several documents have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import encoded, freed, in_groups, map_frames, stored

HASHES_IN_RANGE = 4_000_000
LEAST_RANGES = 16
BATCH_BYTES = 2 << 20


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over all runs of width values, by doubling."""
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def text_batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    for batch in batches:
        texts = encoded(batch["text"])
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH_BYTES):
                size += len(texts[high])
                high += 1
            yield batch.iloc[low:high], texts[low:high]
            low = high


def several(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether the key of each place has more than one owner; places must be sorted by key."""
    if not len(keys):
        return np.zeros(0, bool)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(new) - 1
    first = owners[np.flatnonzero(new)][group]
    return np.bincount(group, owners != first)[group] > 0


def shared_places(docs: DataFrame, find: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], expected: int) -> DataFrame:
    """(doc, places) of the hashes that find gives (hash, text, place) for texts and that at least two documents have; docs has text and doc, which tells documents apart; expected is about the number of hashes. A doc may have several rows.

    Places whose hash two documents of a batch share are settled: they stay with their document, and one of each hash travels
    on, so what stands in very many documents sends at most one place per batch. What travels is packed, by batch and range of hashes;
    it takes more room the more ranges there are, so it and its shuffle are gone before anything else is made of the result, a table of stored().
    """

    ranges = max(LEAST_RANGES, expected // HASHES_IN_RANGE)

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, texts in text_batches(batches):
            hashes, text, place = find(texts)
            owner = batch["doc"].to_numpy().astype(np.int64)[text]
            order = np.argsort(hashes, kind="stable")
            hashes, owner, place = hashes[order], owner[order], place[order]
            settled = several(hashes, owner)
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
            part = (hashes % np.uint64(ranges)).astype(np.int64)
            by = np.flatnonzero(~settled | first)
            by = by[np.lexsort((place[by], owner[by], part[by]))]
            bounds = np.flatnonzero(np.concatenate([[True], part[by][1:] != part[by][:-1], [True]])) if len(by) else []
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = by[a:b]
                docs_, counts = np.unique(owner[own], return_counts=True)
                rows.append((int(part[own[0]]), docs_.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), np.diff(place[own], prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), (hashes[own] // np.uint64(ranges)).astype("<u4").tobytes(), None, None))
            rows += [(None,) * 5 + (int(d), p) for d, p in by_owner(owner[settled], place[settled])]
            yield pd.DataFrame(rows, columns=["part", "docs", "counts", "steps", "hashes", "doc", "places"], dtype=object)

    def gather(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = frame.iloc[a:b]
            owner = np.repeat(np.frombuffer(b"".join(rows["docs"]), "<i8"), np.frombuffer(b"".join(rows["counts"]), "<u4"))
            place = np.concatenate([np.cumsum(np.ascontiguousarray(np.frombuffer(s, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)) for s in rows["steps"]])
            hashes = np.frombuffer(b"".join(rows["hashes"]), "<u4")
            order = np.argsort(hashes, kind="stable")
            keep = order[several(hashes[order], owner[order])]
            out += by_owner(owner[keep], place[keep])
        return pd.DataFrame(out, columns=["doc", "places"])

    found = stored(map_frames(docs.select("doc", "text"), scatter, "part long, docs binary, counts binary, steps binary, hashes binary, doc long, places array<int>"), "hash-places")
    travelled = in_groups(found.where("part is not null").select("part", "docs", "counts", "steps", "hashes"), ["part"], gather, "doc long, places array<int>")
    shared = stored(found.where("doc is not null").select("doc", "places").union(travelled), "shared-places")
    freed(found)
    return shared


def by_owner(owner: np.ndarray, place: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Sorted places of each owner."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order].astype(np.int32)
    names, first = np.unique(owner, return_index=True)
    return list(zip(names.tolist(), np.split(place, first[1:]), strict=True)) if len(names) else []


def second_hash(text: Column) -> Column:
    """60 bits of another hash: with xxhash64 they tell texts apart."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """Texts compressed for a shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in batches:
            yield batch.drop(columns="text").assign(packed=[press.compress(t) for t in encoded(batch["text"])])

    return map_frames(docs.select("doc", "doc_id", "rank", "text_hash", "text"), pack, "doc long, doc_id long, rank long, text_hash long, packed binary")
