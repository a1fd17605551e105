import random

from periodica.llm import ngram_join


def shingle_set(text, width=5):
    words = (text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows):
    """Links and components by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    near = [[i != j and bool(a) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(len(rows)) if near[k][j]} - seen
            seen |= new
            todo += new
        out.append((rows[i][0], min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), sum(near[i]), len(seen)))
    return out


def check(docs, rows):
    got = [(r.doc_id, r.class_id, r.n_links, r.class_size) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_odd_rows(odd, odd_rows, none):
    check(odd, [(r[0], r[1]) for r in odd_rows])
    assert ngram_join.near_duplicates(none).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(ngram_join, "ROWS_IN_BLOCK", 7)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(random.randint(0, 3)):
            text[random.randrange(150)] = word()
        rows.append((i, " ".join(text)))
    rows += [(60 + i, " ".join(word() for _ in range(40))) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(10)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_depths_reach_the_target():
    chosen = ngram_join.depths({(3, 7): 10_000, (3, 6): 10_000}, 0.8, 0.99)
    missed = 1.0
    for d in chosen:
        missed *= 1 - 0.8**d
    assert missed <= 0.01 and chosen[3] == 8
