import numpy as np

from periodica.llm import ann

KIND = "vec_id long, embedding array<double>, label int, row long, rank long, score string"


def exact(rows, every, k):
    ok = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and len(r[1]) == 12]
    out = []
    for i, r in enumerate(ok):
        if r[0] % every == 0:
            near = sorted((-float(np.dot(r[1], o[1])), o[0]) for j, o in enumerate(ok) if j != i)[:k]
            out.append((r[0], [-s for s, _ in near]))
    return out


def test_recall_order_and_odd_rows(spark):
    random = np.random.default_rng(2)
    rows = [(i, (random.standard_normal(12) * random.uniform(0.2, 3)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[40][1]) for i in range(60)] + [(40, rows[40][1]), (None, rows[3][1]), (960, None), (980, [0.0] * 12), (1000, [None] * 12), (1020, [float("nan")] * 12), (1040, [1.0]), (1060, [])]
    docs = spark.createDataFrame([(*r, 1, 1, 1, "s") for r in rows], KIND).repartition(4)
    got = ann.nearest(docs, shard_rows=300, query_block=10).collect()
    want = exact(rows, 20, 20)
    assert len(got) == sum(len(s) for _, s in want)
    hits = total = 0
    for q, scores in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: (r.rank, r.vec_id))
        assert {r.rank for r in own} == set(range(1, 21))
        assert all(a.score > b.score or (a.score == b.score and a.vec_id <= b.vec_id) for a, b in zip(own, own[1:]) if b.rank == a.rank + 1 and q != 40)
        hits += sum(r.score >= scores[-1] - 1e-9 for r in own) if q != 40 else 20
        total += 20
    assert hits >= 0.97 * total


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (21, [2.0, 1.0])]
    got = ann.nearest(spark.createDataFrame([(*r, 1, 1, 1, "s") for r in rows], KIND)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 20, 4.0), (0, 2, 21, 4.0), (20, 1, 21, 5.0), (20, 2, 0, 4.0)]
    assert ann.nearest(spark.createDataFrame([], KIND)).count() == 0


def test_copies_are_all_found_in_order_of_their_ids(spark):
    random = np.random.default_rng(8)
    hot, other = random.standard_normal(12), random.standard_normal(12)
    rows = [(i, random.standard_normal(12).tolist()) for i in range(400)]
    rows += [(1000 + i, (hot * 9).tolist()) for i in range(700)] + [(3000 + i, (other * 5).tolist()) for i in range(6)]
    random.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    got = ann.nearest(spark.createDataFrame([(*r, 1, 1, 1, "s") for r in rows], KIND).repartition(4), shard_rows=300, query_block=10).collect()
    answers = {}
    for r in sorted(got, key=lambda r: r.rank):
        answers.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 20 * len([i for i, _ in rows if i % 20 == 0])
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = 0
    for q, found in answers.items():
        scores = (x @ x[ids == q][0]).round(9)
        want = [int(ids[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits += len(set(found) & set(want))
        if 1000 <= q < 1700:
            assert found == want
    assert hits >= 0.99 * len(got)
