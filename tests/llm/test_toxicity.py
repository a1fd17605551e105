import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from periodica.llm import toxicity
from periodica.llm.queries import op5_toxicity


def test_block_max_search_is_exact():
    random = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        ids = np.sort(random.choice(60, random.integers(1, 9), replace=False))
        w = random.integers(1, 4, len(ids)).astype(float)
        vectors.append((ids, w / np.sqrt(w @ w)))
    index = toxicity.BlockIndex.build(vectors, 60, 16)
    full = np.zeros((500, 60))
    for i, (ids, w) in enumerate(vectors):
        full[i, ids] = w
    for ids, w in vectors[::7]:
        all_scores = full[:, ids] @ w
        want = np.lexsort((np.arange(500), -all_scores.round(12)))[:10]
        found, scores = index.nearest(ids, w, 10)
        assert np.allclose(np.sort(scores)[::-1], all_scores[want][: len(scores)]) and len(found) == min(10, int((all_scores > 0).sum()))


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([0.0, 0.1, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1.0]))
    assert (np.diff(y) >= 0).all() and abs(np.interp(0.15, x, y) - 1 / 3) < 1e-9 and np.interp(1.0, x, y) == 1


def test_held_out_rows_are_told_apart(spark):
    got = op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    caught = sum(s >= 0.3 for s, t in test if t) / sum(t for _, t in test)
    false = sum(s >= 0.3 for s, t in test if not t) / sum(1 - t for _, t in test)
    assert caught >= 0.9 and false <= 0.02 and abs(np.mean([s - t for s, t in test])) < 0.02


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(30)] + [(1, None, "x"), (1, 7, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, labels).count() == 0
    assert {r.score for r in toxicity.score(odd, labels.where(F.lit(False))).collect()} == {0.0}
    long = spark.createDataFrame([(1, "word " * 300_000)], "doc_id long, text string")
    assert toxicity.score(long, labels).count() == 1
    some = sorted({t for w in ("abcdefgh", "abc", "abcde") for t in toxicity.terms_of(w)}, key=toxicity.term_hash)
    vocabulary = toxicity.Vocabulary(np.array([toxicity.term_hash(t) for t in some], np.uint64))
    assert all(set(vocabulary.counts(w)[0]) == {some.index(t) for t in toxicity.terms_of(w)} for w in ("abcdefgh", "abc"))
    ids, n, each, words = vocabulary.counted("Abc abcdefz, abcde 9 abc other")
    assert dict(zip(toxicity.named(ids.tolist(), each, words), n.tolist(), strict=True)) == {"abc": 2, "abcde*": 1, "abcde": 1}


def test_scores_equal_those_of_all_cosines(spark):
    random = np.random.default_rng(5)
    word = lambda toxic: "worse" + "xyz"[random.integers(3)] + "er" if toxic and random.random() < 0.2 else "".join(random.choice(list("aeioustn"), 3 + random.integers(3)))
    rows = [(i, " ".join(word(i % 3 == 0) for _ in range(random.integers(20, 60))), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(999, ""), (5, rows[5][1])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), neighbours=7, per_block=8).collect()}

    terms = lambda t: Counter(x for w in t.lower().split() for x in ([w, w[:5] + "*"] if len(w) > 5 else [w]))
    known = [(i, terms(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    fold = {r.id: r.fold for r in spark.range(300).select("id", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)).alias("fold")).collect()}
    number = {t: i for i, t in enumerate(sorted({t for _, c, _ in known for t in c}))}

    def model(part):
        n, rate = len(part), np.mean([y for *_, y in part])
        seen, toxic = Counter(t for _, c, _ in part for t in c), Counter(t for _, c, y in part if y for t in c)
        lean = {t: max(0, (toxic[t] - seen[t] * rate) / np.sqrt(seen[t] * rate * (1 - rate) + 1) - 1) for t in number}
        weight = {t: (np.log(n / max(seen[t], 1)) + 1) * (0.05 + 0.95 * lean[t] / max(lean.values())) for t in number}

        def vector(counts):
            v = np.zeros(len(number))
            for t, c in counts.items():
                if t in number:
                    v[number[t]] = (1 + np.log(c)) * weight[t]
            return v / max(np.sqrt(v @ v), 1e-300)

        x, y = np.array([vector(c) for _, c, _ in part]), np.array([y for *_, y in part])

        def vote(counts):
            cosine = x @ vector(counts)
            best = np.argsort(-cosine, kind="stable")[:7]
            return (cosine[best] ** 2) @ y[best] / (cosine[best] @ cosine[best])

        return vote

    apart = {f: model([k for k in known if fold[k[0]] != f]) for f in range(5)}
    knots = toxicity.isotonic(np.array([apart[fold[i]](c) for i, c, _ in known]), np.array([float(y) for *_, y in known]), 4.0)
    vote = model(known)
    off = [abs(got[i] - np.interp(vote(terms(t)), *knots)) for i, t, _ in rows]
    assert np.mean(np.array(off) < 1e-3) >= 0.98  # but for ties among the nearest


def test_labels_do_not_speak_for_themselves(spark):
    """Labels without any relation to the texts: calibrated scores stay near their rate."""
    random = np.random.default_rng(8)
    docs = [(i, " ".join("".join(random.choice(list("aeioustn"), 4)) for _ in range(40))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(random.random() < 0.3)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    assert abs(np.mean([r.score for r in got]) - 0.3) < 0.1 and np.std([r.score for r in got]) < 0.15


def test_shrinking_keeps_the_curve_rising():
    x, y = np.arange(8.0), np.array([0, 0, 0, 1, 0, 1, 1, 1.0])
    _, plain = toxicity.isotonic(x, y)
    _, held = toxicity.isotonic(x, y, 2.0)
    assert (np.diff(held) >= 0).all() and held[0] > plain[0] and held[-1] < plain[-1]
