import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from periodica.llm import common, shared_hashes, suffix_dedup
from periodica.llm.queries import op10_suffix_dedup


def plain(rows, length=50):
    """Digests by looking up every run of length bytes."""
    texts = [(d if d is not None else 1 << 63, (t or "").encode()) for d, t in rows]
    first = defaultdict(lambda: 1 << 64)
    for rank, t in texts:
        for i in range(len(t) - length + 1):
            first[t[i : i + length]] = min(first[t[i : i + length]], rank)
    out = []
    for (rank, t), (doc, _) in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < rank:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, str(path)).collect()), key=str)


def test_odd_rows(spark, odd, odd_rows, none, tmp_path):
    assert got(spark, odd, tmp_path / "a") == plain([(r[0], r[1]) for r in odd_rows])
    assert got(spark, none, tmp_path / "b") == []


@pytest.mark.parametrize("hot", [3, 20_000])
def test_passages_at_all_offsets(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(shared_hashes, "BATCH_BYTES", 3000)
    random.seed(8)
    make = lambda n, letters="abcdefgh ": "".join(random.choice(letters) for _ in range(n))
    passage = make(300)
    rows = []
    for i in range(120):
        a = random.randrange(250)
        rows.append((i, make(random.randrange(80)) + passage[a : a + random.randrange(40, 120)] + make(random.randrange(80))))
    rows += [(200 + i, make(400, "ab")) for i in range(20)] + [(300, "x" * 500), (301, "x" * 70), (302, "xy" * 100), (303, "é" * 60), (304, "é" * 30), (305, "\0" * 90), (306, "\0" * 51 + "a"), (307, passage), (308, passage[:50]), (309, passage[1:50])]
    random.shuffle(rows)
    assert got(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tmp_path) == plain(rows)


def test_room_on_disk(spark, odd, tmp_path, monkeypatch):
    """Tables are gone when they are read for the last time, anchors are judged in parts, and texts are shuffled once to meet their places."""
    live, seen, kept = set(), [], common.stored

    def stored(df, name, by=()):
        out = kept(df, name, by)
        live.add(name)
        seen.append((name, frozenset(live)))
        return out

    def freed(*tables):
        removed(*tables)
        live.difference_update(t for x in tables for t in list(live) if any(f"/{t}-" in f for f in x.inputFiles()))

    removed = common.freed
    for module in (shared_hashes, suffix_dedup):
        monkeypatch.setattr(module, "stored", stored)
        monkeypatch.setattr(module, "freed", freed)
    monkeypatch.setattr(suffix_dedup, "PASSES", 3)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = suffix_dedup.remove_repeats(docs)
    assert live == {"suffix-removed"}
    assert all("hash-places" not in at for name, at in seen if name.startswith("suffix-") and name != "suffix-texts")
    assert sum(name == "suffix-distinct" for name, _ in seen) == 3
    assert all("suffix-distinct" not in at for name, at in seen if name == "suffix-removed")
    assert out.count() == docs.count()


def test_texts_are_shuffled_once(spark, odd):
    text = F.coalesce("text", F.lit(""))
    named = odd.select("doc_id", "text", shared_hashes.second_hash(text).alias("text_hash"), F.xxhash64(text).alias("doc"), F.coalesce("doc_id", F.lit(suffix_dedup.LAST)).alias("rank"))
    first = named.groupBy("doc", "text_hash").agg(F.min("rank").alias("first"))
    shared = shared_hashes.shared_places(named, lambda texts: suffix_dedup.anchors(texts, 50), 1)
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        plan = suffix_dedup.slices(named, shared, first, 50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "Exchange" not in plan[plan.index("first(packed") : plan.index("SortMergeJoin")]
