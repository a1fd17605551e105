"""N-gram Jaccard join: an LSH forest of min-hash signatures proposes groups, exact set comparison verifies them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.blocks import in_blocks, settled, smallest_linked
from periodica.llm.common import components, encoded, map_frames, shingles, stored

TREES, DEPTH, FLOOR = 16, 8, 4
ROWS_IN_BLOCK, SHINGLES_IN_BLOCK = 1024, 2_000_000
VOCABULARY_STEP = 4096
#: Texts are hashed in batches of about so many bytes.
BATCH_BYTES = 1 << 20


def distinct_shingles(texts: pd.Series, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    coded = encoded(texts)
    low = 0
    while low < len(coded):
        high, size = low, 0
        while high < len(coded) and (high == low or size + len(coded[high]) <= BATCH_BYTES):
            size += len(coded[high])
            high += 1
        hashes, cuts = shingles(coded[low:high], width)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(hashes[a:b])
        low = high


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-hashes by multiply-shift, 32 bits each."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for part in np.array_split(values, max(1, len(values) // 2048)):
        out = np.minimum(out, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1, initial=0xFFFFFFFF))
    return out.astype("<u4")


def hash_functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(seed))
    a, b = random.integers(1, 1 << 63, (2, TREES * DEPTH), np.int64).astype(np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signed(docs: DataFrame, row: str, width: int, seed: int) -> DataFrame:
    """(at, row, text_hash, key, size, sig) of each document, where at numbers them; key tells sets of shingles apart, sig is null without shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = hash_functions(seed)
        for batch in batches:
            keys, sizes, sigs, done = [], [], [], {}
            for values in distinct_shingles(batch["text"], width):
                key = set_key(values)
                if key not in done:
                    done[key] = signature(values, a, b).tobytes() if len(values) else None
                keys.append(key)
                sizes.append(len(values))
                sigs.append(done[key])
            yield pd.DataFrame({"at": batch["at"], "row": batch["row"], "text_hash": batch["text_hash"], "key": keys, "size": sizes, "sig": sigs})

    return map_frames(docs.select(F.monotonically_increasing_id().alias("at"), F.col(row).alias("row"), F.xxhash64("text").alias("text_hash"), "text"), run, "at long, row long, text_hash long, key binary, size long, sig binary")


def tries(classes: DataFrame) -> DataFrame:
    """Edges (a, b, tree, depth): each signature and the first one in the sorted trie of its tree that shares its longest prefix with the one before it."""

    def branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"]), "<u4").reshape(-1, TREES, DEPTH)
            key = np.repeat(batch["key"].to_numpy(), TREES)
            flat = sig.reshape(-1, DEPTH).astype(np.int64)
            frame = pd.DataFrame({"tree": np.tile(np.arange(TREES), len(batch)), "key": key, "p": [r.tobytes() for r in flat[:, :FLOOR].astype("<u4")]})
            for d in range(FLOOR, DEPTH):
                frame[f"v{d}"] = flat[:, d]
            yield frame

    deeper = [f"v{d}" for d in range(FLOOR, DEPTH)]
    rows = map_frames(classes.select("key", "sig"), branches, "tree int, key binary, p binary, " + ", ".join(f"{v} long" for v in deeper))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list | None = None
        heads: dict[int, bytes] = {}
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            shared = np.zeros(n, np.int64)
            same = np.ones(n, bool)
            for c in ("tree", "p", *deeper):
                values = batch[c].to_numpy()
                same[1:] &= values[1:] == values[:-1]
                same[0] &= last is not None and values[0] == last[0][c]
                if c == "p":
                    shared[same] = FLOOR
                elif c != "tree":
                    shared[same] += 1
            keys, out = batch["key"].to_numpy(), []
            for d in range(FLOOR, DEPTH + 1):
                begin = np.maximum.accumulate(np.where(shared < d, np.arange(n), -1))
                at = np.flatnonzero(shared == d)
                if len(at):
                    out.append(pd.DataFrame({"a": keys[at], "b": [keys[i] if i >= 0 else heads[d] for i in begin[at]], "tree": batch["tree"].to_numpy()[at], "depth": d}))
                if begin[-1] >= 0:
                    heads[d] = keys[begin[-1]]
            last = [batch.iloc[-1]]
            if out:
                yield pd.concat(out)

    return map_frames(rows.repartition("tree", "p").sortWithinPartitions("tree", "p", *deeper), walk, "a binary, b binary, tree int, depth int")


def depths(added: dict[tuple[int, int], int], similarity: float, recall: float) -> list[int]:
    """Prefix length of each tree: the tree whose next shortening adds fewest edges for its gain is shortened, until the recall of a pair at the threshold is reached."""
    out = [DEPTH] * TREES
    missed = lambda d: 1 - similarity**d
    while 1 - np.prod([missed(d) for d in out]) < recall:
        open_trees = [t for t in range(TREES) if out[t] > FLOOR]
        if not open_trees:
            raise ValueError(f"{TREES} tries of prefixes of {FLOOR} to {DEPTH} cannot reach a recall of {recall} at a similarity of {similarity}")
        gain = lambda t: np.log(missed(out[t])) - np.log(missed(out[t] - 1))
        t = min(open_trees, key=lambda t: ((1 + added.get((t, out[t] - 1), 0)) / gain(t), t))
        out[t] -= 1
    return out


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, VOCABULARY_STEP):
        a, b = np.searchsorted(column, [low, low + VOCABULARY_STEP])
        present, local = np.unique(owner[a:b], return_inverse=True)
        matrix = np.zeros((len(present), VOCABULARY_STEP), np.float32)
        matrix[local, column[a:b] - low] = 1
        out[np.ix_(present, present)] += matrix @ matrix.T
    return out


def verified(members: DataFrame, similarity: float) -> DataFrame:
    """members: (candidates, key, copies, size, set). Returns (key, root, links, whole): links to documents of other keys in a pair of blocks, and the first key linked there; whole if no other block exists."""

    def run(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = frame.iloc[a:b].sort_values("key")
            part = part[~part["key"].duplicated()]
            sets = [np.frombuffer(s, "<u8") for s in part["set"]]
            sizes = np.array([len(s) for s in sets], np.float64)
            both = shared_counts(sets)
            linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
            np.fill_diagonal(linked, False)
            block = part["block"].to_numpy()
            first = part.iloc[0]
            if first["low"] != first["high"]:
                linked &= block[:, None] != block[None, :]
            keys = part["key"].to_numpy()
            root = keys[smallest_linked(linked)]
            out.append(pd.DataFrame({"key": keys, "root": root, "links": linked @ part["copies"].to_numpy().astype(np.int64), "whole": bool(first["blocks"] == 1)}))
        return pd.concat(out)

    return in_blocks(members, "candidates", "key", ROWS_IN_BLOCK, run, "key binary, root binary, links long, whole boolean", "size", SHINGLES_IN_BLOCK)


def near_duplicates(docs: DataFrame, row: str = "doc_id", width: int = 5, similarity: float = 0.8, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """Groups of documents whose sets of word n-grams have a Jaccard similarity of at least similarity.

    docs has a long column row, which need not be unique, and text. Words are runs of other characters than ASCII blanks;
    a text of fewer than width words has one n-gram, of all of them; a null or blank text has none and joins no group.

    Documents of one and the same set become one class. Signatures of 16 x 8 min-hashes of the classes stand in 16
    sorted prefix tries. All tries start at whole prefixes of 8; prefixes are shortened, one tree at a time and cheapest first,
    until the modelled recall of a pair at the threshold reaches recall (an error where prefixes of 4 cannot). Classes that meet in a trie form candidate
    groups, whose pairs are all compared exactly, in blocks of bounded size. Every document counts its links, copies
    included, without any pair being written.

    Returns one row per document: row, class_id (smallest row of all that links lead to; its own without links; null if
    that is null), n_links (other documents linked directly), class_size, kept (true for one row of each group, of the smallest
    row, and for all rows outside groups), text_hash, size (distinct n-grams). Repeated rows count as documents
    of their own; extra columns are ignored; an empty table gives no rows.
    """
    each = stored(signed(docs, row, width, seed), "ngram-signatures")
    classes = each.where("sig is not null").groupBy("key").agg(F.min("row").alias("row"), F.min(F.struct(F.isnull("row"), "row", "at")).alias("head"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("sig").alias("sig"))
    classes = stored(classes, "ngram-classes")
    edges = stored(tries(classes), "ngram-tries")
    added = {(r[0], r[1]): r[2] for r in edges.groupBy("tree", "depth").count().collect()}  # at most TREES x DEPTH rows
    chosen = depths(added, similarity, recall)
    near = edges.where(F.col("depth") >= F.element_at(F.array(*[F.lit(d) for d in chosen]), F.col("tree") + 1))
    candidates = components(near.select("a", "b").distinct())
    wanted = candidates.select(F.col("id").alias("key"), F.col("component").alias("candidates")).join(classes.drop("sig", "head"), "key")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = list(distinct_shingles(batch["text"], width))
            right = [set_key(v) == k for v, k in zip(values, batch["key"], strict=True)]
            batch = batch.drop(columns="text").assign(set=[v.astype("<u8").tobytes() for v in values])
            yield batch[right]

    texts = docs.select(F.col(row).alias("row"), "text")
    found = texts.join(wanted.withColumnRenamed("row", "wanted"), texts["row"].eqNullSafe(F.col("wanted")))
    members = map_frames(found.select("candidates", "key", "copies", "size", "text"), sets, "candidates binary, key binary, copies long, size long, set binary")
    links = stored(verified(members, similarity), "ngram-links")
    grouped = classes.drop("sig", "size").join(settled(links), "key", "left").withColumn("component", F.coalesce("component", "key"))
    totals = grouped.groupBy("component").agg(F.min("row").alias("class_id"), F.min("head").alias("head"), F.sum("copies").alias("class_size"))
    classed = grouped.drop("head").join(totals, "component").select("key", "head", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return each.join(classed, "key", "left").select("row", own("class_id", F.col("row")), own("n_links", F.lit(0)), own("class_size", F.lit(1)), ((F.col("size") == 0) | (F.col("at") == F.col("head.at"))).alias("kept"), "text_hash", "size").withColumnRenamed("row", row)


def own(name: str, otherwise: Column) -> Column:
    """The class's value, or otherwise for a document without n-grams."""
    return F.when(F.col("size") > 0, F.col(name)).otherwise(otherwise).cast("long").alias(name)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text and more) of which near_duplicates keeps one of each group; all columns stay.

    Null and blank texts all stay. Of rows equal in doc_id and text one stays. An empty table gives no rows.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "size")
    kept = stored(kept.groupBy("kept_id", "kept_hash").agg(F.max("size").alias("size")), "ngram-kept")
    same = docs["doc_id"].eqNullSafe(F.col("kept_id")) & (F.xxhash64(docs["text"]) == F.col("kept_hash"))
    left = docs.join(kept, same, "left_semi")
    repeated = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).count().where("count > 1").drop("count")
    if not repeated.take(1):
        return left
    # rows equal in doc_id and text: one of them stays, unless they have no n-grams
    again = F.broadcast(repeated) if repeated.limit(10_001).count() <= 10_000 else repeated
    of = lambda other: left["doc_id"].eqNullSafe(other["doc_id"]) & (F.xxhash64(left["text"]) == other["text_hash"])
    twice = left.join(again, of(again), "left_semi")
    bare = twice.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    worded = twice.where(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["doc_id", "text"])
    return left.join(again, of(again), "left_anti").unionByName(bare).unionByName(worded)
