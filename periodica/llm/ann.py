"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched with beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import in_groups, map_frames, stored
from periodica.llm.vectors import matrix, usable

EXPAND = 4


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products, best first, of the beam best points of each query found by greedy best-first walks; -1 where fewer. All queries step together, each expanding its best EXPAND open points."""
    n = len(queries)
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    ids = np.full((n, beam), -1)
    score = np.full((n, beam), -np.inf, np.float32)
    ids[:, 0], score[:, 0] = start, queries @ x[start]
    open_ = np.zeros((n, beam), bool)
    open_[:, 0] = True
    active = np.arange(n)
    while len(active):
        rank = np.where(open_[active], score[active], -np.inf)
        pick = np.argsort(-rank, axis=1, kind="stable")[:, :EXPAND]
        chosen = np.take_along_axis(rank, pick, 1) > -np.inf
        at = np.take_along_axis(ids[active], pick, 1)
        open_[active[:, None], pick] = False
        near = np.where(chosen[:, :, None], graph[at], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        new = (near >= 0) & ~seen[active[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        found = near[row, col]
        seen[active[row], found] = True
        values = np.full(near.shape, -np.inf, np.float32)
        values[row, col] = np.einsum("ij,ij->i", x[found], queries[active[row]])
        all_score = np.concatenate([score[active], values], axis=1)
        order = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        score[active] = np.take_along_axis(all_score, order, 1)
        ids[active] = np.where(score[active] > -np.inf, np.take_along_axis(np.concatenate([ids[active], near], axis=1), order, 1), -1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new], axis=1), order, 1)
        active = active[open_[active].any(axis=1)]
    return ids, score


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each point from its row of candidates (-1: none): the nearest is kept and drops all that are alpha times nearer to it than to the point, again and again."""
    out = np.full((len(points), degree), -1)
    for low in range(0, len(points), 512):
        p, c = points[low : low + 512], np.sort(candidates[low : low + 512], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == p[:, None]] = -1
        to_point = np.maximum(0, np.where(c >= 0, 1.0, np.inf) * (2 * (1 - np.einsum("ijk,ik->ij", x[c], x[p]))))
        order = np.argsort(to_point, axis=1, kind="stable")
        c, to_point = np.take_along_axis(c, order, 1), np.take_along_axis(to_point, order, 1)
        some = x[c]
        between = 2 * (1 - some @ some.transpose(0, 2, 1))
        alive = c >= 0
        rows = np.arange(len(p))
        for k in range(degree):
            any_left = alive.any(axis=1)
            if not any_left.any():
                break
            first = alive.argmax(axis=1)
            out[low : low + 512][any_left, k] = c[any_left, first[any_left]]
            alive &= alpha * alpha * between[rows, first] > to_point
            alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> tuple[np.ndarray, int]:
    """Graph over rows of equal length 1, and the point nearest to their mean, where walks begin. Points enter in random order, in batches that grow with the graph."""
    n = len(x)
    start = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    width = degree + degree // 2  # lists may outgrow degree a little before they are pruned again
    graph, done = np.full((n, width), -1), 1
    while done < n:
        batch = order[done : done + min(1024, max(8, done // 2))]
        found, _ = beam_search(x, graph, start, x[batch], beam)
        graph[batch, :degree] = robust_prune(x, batch, found, degree, alpha)
        graph[batch, degree:] = -1
        source, target = np.repeat(batch, degree), graph[batch, :degree].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(points), count.max()), -1)
        back[np.repeat(np.arange(len(points)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        merged = np.concatenate([graph[points], back], axis=1)
        used = np.sort(np.where(merged >= 0, merged, n), axis=1)
        used = np.where(used < n, used, -1)
        full = (used >= 0).sum(axis=1) > width
        graph[points[~full]] = used[~full, :width]
        if full.any():
            graph[points[full], :degree] = robust_prune(x, points[full], used[full], degree, alpha)
            graph[points[full], degree:] = -1
        done += len(batch)
    return graph, start


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more component, in whose distances the largest inner product with any query is nearest."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]], axis=1).astype(np.float32)


def nodes(ready: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """One row per distinct vector: (row, vector, members), members being its k smallest (vec_id, row) in order and row the first's.

    Copies are thinned to k within each of a few hash classes first, so no task meets all copies of a common vector.
    """
    thinned = ready.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(29)), F.lit(salts)))
    for by in (["vector", "salt"], ["vector"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id", "row"))
        thinned = thinned.withColumn("place", place).where(F.col("place") <= k).drop("place")
    grouped = thinned.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    return grouped.select(F.col("members")[0]["row"].alias("row"), "vector", "members")


def index(points: DataFrame, longest: float, shards: int, degree: int, beam: int, alpha: float, seed: int) -> DataFrame:
    """One row per shard of points (row, vector, members): vectors, graph and, side by side with -1 for none, rows and ids of the members of each, as binary."""

    def build(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = frame.iloc[a:b].sort_values("row")
            graph, start = build_graph(lifted(matrix(part["vector"]), longest), degree, beam, alpha, seed)
            members = list(part["members"])
            rows, ids = np.full((2, b - a, max(map(len, members))), -1, "<i8")
            for at, some in enumerate(members):
                rows[at, : len(some)], ids[at, : len(some)] = [m["row"] for m in some], [m["vec_id"] for m in some]
            out.append((part["shard"].iloc[0], b - a, start, rows.tobytes(), ids.tobytes(), b"".join(part["vector"]), graph.astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["shard", "n", "start", "rows", "ids", "vectors", "graph"], dtype=object)

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)).cast("int"))
    return in_groups(dealt, ["shard"], build, "shard int, n int, start int, rows binary, ids binary, vectors binary, graph binary")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = 8192, degree: int = 40, build_beam: int = 100, beam: int = 192, alpha: float = 1.2, query_block: int = 1024, seed: int = 5) -> DataFrame:
    """The k rows of largest inner product for each row whose vec_id is divisible by every, among all other rows.

    Equal vectors are one point with the k + 1 smallest vec_ids, which is all of its copies that an answer can hold.
    Points are dealt out at random to shards of about shard_rows. Each shard gets a directed graph: points enter one
    batch after another, a greedy search over the graph so far proposes their neighbours, pruning with slack alpha keeps
    diverse ones, and edges back are pruned alike. Inner products become distances by one more component.
    Blocks of queries then walk every shard's graph with a beam; copies of the points found, of all shards, are ranked by their inner products
    in double precision. Recall against a full comparison is measured in the tests.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id or
    of another length than most (ties: the longer). Repeated vec_ids are rows of their own: each asks, and each can be found by others. Extra
    columns are ignored; an empty table gives no rows.

    Returns query_id, rank (from 1; ties to the smaller vec_id), vec_id, score.
    """
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding").where("vec_id is not null")
    ready = stored(usable(numbered, "row", "vec_id long").where("vector is not null"), "ann-vectors")
    length = ready.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    ready = ready.where(F.length("vector") == (length[0] if length else 8))

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["vector"])
            yield pd.DataFrame({"length": np.sqrt(np.einsum("ij,ij->i", x, x))})

    points = stored(nodes(ready, k + 1), "ann-points")
    n, longest = map_frames(points.select("vector"), lengths, "length double").agg(F.count("*"), F.max("length")).first()
    shards = max(1, -(-n // shard_rows))
    built = stored(index(points, float(longest or 1), shards, degree, build_beam, alpha, seed), "ann-index")
    asked = ready.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-ready.count() // (every * query_block)))
    grouped = asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed + 1)), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("row", "vec_id", "vector")).alias("q"))
    work = grouped.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(built, "shard")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = np.frombuffer(r.vectors, "<f8").reshape(r.n, -1)
                rows, ids, graph = np.frombuffer(r.rows, "<i8").reshape(r.n, -1), np.frombuffer(r.ids, "<i8").reshape(r.n, -1), np.frombuffer(r.graph, "<i4").reshape(r.n, -1)
                light = lifted(x, float(longest))
                for low in range(0, len(r.q), 256):
                    part = r.q[low : low + 256]
                    q = np.frombuffer(b"".join(p["vector"] for p in part), "<f8").reshape(len(part), -1)
                    own, name = np.array([p["row"] for p in part]), np.array([p["vec_id"] for p in part])
                    scaled = q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
                    found, _ = beam_search(light, graph, r.start, np.concatenate([scaled, np.zeros((len(part), 1))], axis=1).astype(np.float32), max(beam, 2 * k))
                    exact = np.where(found >= 0, np.einsum("ijk,ik->ij", x[found], q), -np.inf)
                    order = np.lexsort((ids[found, 0], -exact), axis=1)[:, : k + 1]  # one more, since the query's own row may be a point's only member
                    near = np.take_along_axis(found, order, 1)
                    member, names = rows[near].reshape(len(part), -1), ids[near].reshape(len(part), -1)
                    exact = np.repeat(np.take_along_axis(exact, order, 1), rows.shape[1], axis=1)
                    exact = np.where((member >= 0) & (member != own[:, None]), exact, -np.inf)
                    order = np.lexsort((names, -exact), axis=1)[:, :k]
                    best = np.take_along_axis(exact, order, 1)
                    row, col = np.nonzero(best > -np.inf)
                    at = np.take_along_axis(names, order, 1)[row, col]
                    yield pd.DataFrame({"query_row": own[row], "query_id": name[row], "vec_id": at, "score": best[row, col]})

    pairs = map_frames(work.select("q", "n", "start", "rows", "ids", "vectors", "graph"), search, "query_row long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
