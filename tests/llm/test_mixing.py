import re
from collections import defaultdict

from periodica.llm import mixing


def plain_targets(sizes, weights, limit=3):
    """Raise one common level until all sizes are shared out; a source stops at limit times its size."""
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(limit * sizes[s], level * weights[s]) for s in sizes) < sum(sizes.values()):
            low = level
        else:
            high = level
    return {s: min(limit * sizes[s], high * weights[s]) for s in sizes}


def test_targets_share_all_and_stop_at_the_limit():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    out = mixing.targets([1000, 10, 10, 0], [1, 2, 3, 1])
    assert out[1:] == [30.0, 30.0, 0.0] and out[0] == 960.0


def test_permutation_and_tree_are_exact():
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(x, n, 11) for x in range(n)) == list(range(n))
    tree = mixing.SplittingTree([50, 7, 0, 400], 13, 5)
    places = [[tree.shard(s, p) for p in range(n)] for s, n in enumerate([50, 7, 0, 400])]
    assert all(len(set(p)) == len(p) for p in places)
    per = defaultdict(int)
    for p in places:
        for shard, _ in p:
            per[shard] += 1
    assert max(per.values()) - min(per.values()) <= 2 and sum(per.values()) == 457


def test_sources_meet_targets(odd, odd_rows, none):
    rows = mixing.mix(odd, block_words=50, shard_blocks=4).collect()
    assert len(rows) == len(odd_rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in rows) == sorted((-1 if r[0] is None else r[0], size(r[1])) for r in odd_rows)
    total = defaultdict(int)
    for r in odd_rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    aims = plain_targets({s: total[s] for s in names}, {s: i % 3 + 1 for i, s in enumerate(names)})
    taken, slots = defaultdict(int), set()
    for r in rows:
        assert r.taken <= 3 * r.size and r.source_size == total[r.source] and abs(r.target - aims[r.source]) < 1e-6
        assert sum(p.length for p in r.pieces) == r.taken and all(p.start + p.length <= r.size for p in r.pieces)
        taken[r.source] += r.taken
        slots |= {(r.source, p.copy, p.shard, p.slot) for p in r.pieces}
    assert all(abs(taken[s] - aims[s]) <= 1 for s in names)
    assert len({x[2:] for x in slots}) == len(slots)
    again = mixing.mix(odd.repartition(7), block_words=50, shard_blocks=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)
    assert mixing.mix(none).count() == 0


def test_drawn_blocks_lie_at_their_shards_and_slots(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20 + i % 50)), "en", f"s{i % 3}", 0) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    pieces = [(r.doc_id, p.shard, p.slot, p.length) for r in mixing.mix(docs, block_words=50, shard_blocks=100).collect() for p in r.pieces]
    placed = mixing.drawn(docs, block_words=50, shard_blocks=100)
    placed.write.parquet(f"{tmp_path}/mix")
    rows = [[(r.doc_id, r.shard, r.slot, len(r.text.split())) for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "mix").glob("*.parquet"))]
    assert sorted(x for part in rows for x in part) == sorted(pieces)
    for part in rows:
        assert [x[1:3] for x in part] == sorted(x[1:3] for x in part)
    chunks = [{(s, slot // mixing.CHUNK) for _, s, slot, _ in part} for part in rows]
    assert sum(map(len, chunks)) == len(set().union(*chunks))
    source = [d % 3 for part in rows for d, *_ in part]
    assert sum(a != b for a, b in zip(source, source[1:])) > 50
