import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from test_ngram_join import shingle_set
from test_packing import expected
from test_secrets import base

from periodica.llm import mixing
from periodica.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages_on_small_tables(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    whole = before.collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    calm = stages["toxicity"](spark, before, SF)
    rows = calm.collect()
    assert calm.columns == before.columns and set(rows) <= set(whole)
    clean = {r.doc_id for r in whole if labels.get(r.doc_id) == 0}
    assert len({r.doc_id for r in rows} & clean) >= 0.95 * len(clean)

    single = stages["near_duplicates"](spark, before, SF).collect()
    sets = {r.doc_id: shingle_set(r.text) for r in whole}
    near = lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b)
    kept = {r.doc_id for r in single}
    assert len(single) == len(kept) and set(single) <= set(whole)
    assert not any(near(sets[a], sets[b]) for a in kept for b in kept if a < b)
    assert all(any(near(sets[d], sets[o]) for o in sets if o != d) for d in sets.keys() - kept)

    redacted = {r.doc_id: r for r in stages["secrets"](spark, before, SF).collect()}
    assert redacted.keys() == {r.doc_id for r in whole}
    assert not any(base(r.text) for r in redacted.values()) and all(r.n_chars == len(r.text) for r in redacted.values())
    assert any("[SECRET]" in r.text for r in redacted.values())
    text = {r.doc_id: r.text for r in whole}
    assert all(redacted[d].text == text[d] for d in text if "[SECRET]" not in redacted[d].text)

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken = Counter(), Counter()
    for r in whole:
        total[r.source] += size(r.text)
    source = {r.doc_id: r.source for r in whole}
    mixed = stages["mixing"](spark, before, SF).collect()
    for r in mixed:
        taken[r.source] += size(r.text)
        assert r.source == source[r.doc_id] and r.text in text[r.doc_id] and r.n_chars == len(r.text)
    names = sorted(total)
    aims = mixing.targets([total[s] for s in names], [i % 3 + 1 for i in range(len(names))])
    assert all(abs(taken[s] - a) <= 1 for s, a in zip(names, aims, strict=True))

    pieces = stages["packing"](spark, before, SF).collect()
    own = defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
    want = expected(tokenizer_file("word_bpe_49k.json"), [r.text for r in whole])
    for r, ids in zip(whole, want, strict=True):
        got = b"".join(bytes(p.ids) for p in sorted(own[r.doc_id], key=lambda p: p.start))
        assert np.frombuffer(got, "<u4").tolist() == ids


def test_odd_rows_pass_every_stage(spark, odd, odd_rows, none):
    for docs, most in ((odd, 0), (none, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
            assert (len(rows) > most) == (docs is odd)
    copies = Counter((r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, odd, SF).collect())
    assert max(n for (_, t), n in copies.items() if (t or "").strip()) == 1


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
