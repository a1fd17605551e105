import duckdb
import numpy as np
from pyspark.sql import functions as F

from periodica.llm import embedding_dedup
from periodica.llm.queries import ORACLES, QUERIES
from periodica.llm.vectors import usable

KIND = "vec_id long, embedding array<double>, label int, row long, code long"


def plain(rows):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    x = [np.array(r[1], float) if ok(r[1]) and r[2] is not None else None for r in rows]
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    near = [[i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and cosine(a, b) >= 0.98 for j, b in enumerate(x)] for i, a in enumerate(x)]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(len(rows)) if near[k][j]} - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], sum(near[i]), least, r[0] is not None and r[0] == least))
    return sorted(out, key=str)


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_IN_BLOCK", 16)
    random = np.random.default_rng(4)
    centre = random.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] * random.uniform(0.1, 9) + random.standard_normal(16) * 0.12).tolist(), i % 2) for i in range(150)]
    rows += [(150 + i, random.standard_normal(16).tolist(), i % 3) for i in range(80)]
    same = rows[7][1]
    rows += [(300 + i, same, 1) for i in range(50)] + [(7, same, 1), (None, same, 1), (400, same, None), (401, None, 1), (402, [0.0] * 16, 1), (403, [None] + same[1:], 1), (404, [float("inf")] + same[1:], 1), (405, [], 1), (406, same[:4], 1), (407, same[:4], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, 5, 5) for r in rows], KIND).repartition(3), window=8).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == plain(rows)


def test_passes_find_links_of_dense_labels(spark):
    random = np.random.default_rng(9)
    rows = []
    for label, common in ((0, 0.0), (1, 0.7)):
        axis = np.eye(32)[0] * np.sqrt(common)
        centre = np.array([axis + v / np.linalg.norm(v) * np.sqrt(1 - common) for v in random.standard_normal((2500, 32))])
        for i, c in enumerate(centre):
            rows.append((len(rows), c.tolist(), label))
            if i % 10 == 0:  # a partner just over the threshold
                away = random.standard_normal(32)
                away -= (away @ c) * c / (c @ c)
                rows.append((len(rows), (c * 0.982 + away / np.linalg.norm(away) * np.linalg.norm(c) * np.sqrt(1 - 0.982**2)).tolist(), label))
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, 5, 5) for r in rows], KIND), window=16).collect()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    links = linked.sum(axis=1) - 1
    found = np.zeros(len(rows), int)
    found[[r.vec_id for r in got]] = [r.n_links for r in got]
    assert (found <= links).all() and links.sum() >= 1000
    assert found.sum() >= 0.995 * links.sum()


def test_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_labels_of_every_size_take_the_passes(spark):
    """Labels of one window, of a few and of a mean cosine at the threshold: the same links as the comparison of all."""
    random = np.random.default_rng(2)
    rows = []
    for label, n, noise in ((0, 40, 1.0), (1, 400, 1.0), (2, 200, 0.002)):
        centre = np.ones(24)
        for _ in range(n // 2):
            v = centre * (noise < 1) + random.standard_normal(24) * noise
            rows += [(len(rows) + k, (v + random.standard_normal(24) * 0.015 * k).tolist(), label) for k in (0, 1)]
    frame = spark.createDataFrame([(*r, 5, 5) for r in rows], KIND)
    named = usable(frame.withColumn("row", F.monotonically_increasing_id()).withColumn("label", F.col("label").cast("string")), "row", "label string").where("vector is not null")
    passes = {r.label: r.passes for r in embedding_dedup.plans(named, 64, 0.98, 0.9995).collect()}
    assert passes["0"] == 1 and passes["1"] >= 2 and passes["2"] == 0
    got = embedding_dedup.near_duplicates(frame).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == plain(rows)


def test_registered_query_equals_its_sql(spark):
    duckdb.execute("create or replace view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    names = "vec_id, n_links, component_id, kept"
    want = duckdb.sql(f"select {names} from ({ORACLES['op4_embedding_dedup']}) order by vec_id").fetchall()
    assert [tuple(r) for r in QUERIES["op4_embedding_dedup"](spark, "/root/testdata/sf0.01").select(*names.split(", ")).orderBy("vec_id").collect()] == want
