import hashlib
import re

from pyspark.sql import functions as F

from periodica.llm import middle
from periodica.llm.queries import op13_fill_in_middle


def brute(doc_id, text, rate=90, suffix_first=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h4 % 100 < suffix_first:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_brute_force_and_comes_back(spark, odd, odd_rows, none):
    rows = [(r[0], r[1]) for r in odd_rows] + [(60, "a<P>b"), (61, "<S"), (62, "P><M>"), (63, "\n\r\n\x00"), (64, "<" * 40 + "S>" * 20), (65, "ab" * 3000 + "é🙂" * 700 + "Z"), (66, "A"), (67, "🙂")]
    rows += [(i, "<S" * (i % 7) + ">P<M" * (i % 5) + "word. " * (i % 11)) for i in range(100, 400)]
    docs = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, form string, n int").repartition(3)
    out = middle.shuffled(docs)
    key = lambda r: str(r)
    assert sorted([tuple(r) for r in out.collect()], key=key) == sorted([brute(*r) for r in rows], key=key)
    back = out.select("doc_id", middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=key) == sorted([(i, t or "") for i, t in rows], key=key)
    assert middle.shuffled(none).count() == 0
    assert {r.form for r in middle.shuffled(docs, rate=100, suffix_first=100).collect()} == {"plain", "spm"}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(*b[:5], sha(b[5]), sha(t or "")) for i, t in texts.items() for b in [brute(i, t)]}
    assert {tuple(r) for r in op13_fill_in_middle(spark, sf).collect()} == want
