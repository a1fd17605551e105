import hashlib
from collections import defaultdict

import pytest

from periodica.llm import line_dedup
from periodica.llm.queries import op11_line_dedup

BLANK = " \t\n\v\f\r"


def brute(rows, least_docs=5):
    """(doc_id, text) without lines that least_docs ids hold, but in the largest."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    last = {k: max(h, key=lambda i: -1 if i is None else i) for k, h in holders.items() if len(k) >= 40 and len(h) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def sorted_rows(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 4), (5, 2), (8, 3)])
def test_equals_brute_force_in_any_levels(spark, odd_rows, batches, fanout):
    lines = ["A common  LINE of many words that stands in many documents", "\tÜber eine Zeile, die ebenfalls häufig vorkommt: größer", "x" * 39, "y" * 40, " " * 50, "é" * 40]
    rows = [(r[0], r[1]) for r in odd_rows]
    rows += [(100 + i, "\n".join([lines[i % 6], f"own line {i}", lines[(i * 5) % 6].swapcase() + " \r", "", lines[i % 6]])) for i in range(60)]
    rows += [(130, lines[0]), (None, lines[0] + "\n" + lines[3]), (200, lines[3] + "\n\n"), (-5, lines[0].lower()), (201, "\n")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, high int, last string").repartition(5)
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout).collect()]
    want = brute(rows)
    assert sorted_rows(got) == sorted_rows(want) and sum(w[3] for w in want) > 100


def test_runs_stay_disjoint_and_few(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(6):
        runs.add(spark.createDataFrame([(k, -k, 10 * b + d) for k in range(b, b + 4) for d in range(2)] * 2, "high long, low long, doc_id long"))
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    fresh = runs.of([n for level in runs.levels for n in level]).where("fresh").collect()
    assert len({r.high for r in fresh}) == len(fresh) == 9
    assert {(r.high, r.n_docs, r.last) for r in runs.keys().collect()} == {(k, 2 * len(bs), 10 * max(bs) + 1) for k in range(9) if (bs := [b for b in range(6) if b <= k < b + 4])}
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_hot_line_and_empty_table(spark, none):
    rows = [(i, "the same very long line that all documents have in common\n" + f"and a line {i % 400} that several of them share with others") for i in range(4000)]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(r.n_dropped for r in got.values()) == 3999 + 3600 and got[3999].n_dropped == 0 and got[3998].n_dropped == 1
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op11_line_dedup(spark, sf).collect()}
    assert got == {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows)}
