import re
from collections import Counter
from itertools import permutations

from periodica.llm import filter_audit
from periodica.llm.queries import op12_filter_audit


def brute(rows, labels):
    """rows of (doc_id, text, lang); labels of (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and i > least[text] else set()
        docs.append((lang or "", fails, i in good, i in toxic))
    out, totals = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                totals[part, f] += len(now)
                out[part, "".join(order), step] = [len(left), len(now), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in now), sum(d[3] for d in now)]
                gone += now
    return {(*k, *v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_equals_brute_force(spark, odd_rows, none):
    rows = [(r[0], r[1], r[2]) for r in odd_rows]
    rows += [(500 + i, "Same text $ of copies " * (1 + i % 3) * 30, ("en", "fr", None, "de")[i % 4]) for i in range(90)] + [(700, "WORD " * 300, "de"), (701, "WORD " * 300, "es"), (None, "WORD " * 300, "es"), (702, None, "es")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, n int, good boolean").repartition(4)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 600, 2)] + [(500, None, 1), (None, 1, 1), (502, 1, None), (502, 0, 0)]
    got = {tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame([(*x, "c") for x in labels], "doc_id long, quality int, toxic int, part string")).collect()}
    assert got == brute(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_words_of_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 7)
    for text in (b"", b"   ", b"a bb a\tccc\x0bccc \n dddddddddddddddddd a", b"x" * 50, b" a" * 40):
        assert filter_audit.word_counts(text) == (len(text.split()), len(set(text.split())))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert {tuple(r) for r in op12_filter_audit(spark, sf).collect()} == brute(rows, labels)
