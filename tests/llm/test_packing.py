import zlib
from collections import defaultdict

import numpy as np
import pytest

from periodica.llm import packing
from periodica.llm.queries import tokenizer_file


def expected(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_words_are_cut_like_the_tokenizer():
    path = tokenizer_file("word_bpe_49k.json")
    ids = packing.WordIds(path)
    for text in ["It's  THE\tend of ΣΑΣ é ²³ 12a_b", "a\x1cb <|endoftext|> c", "", "́x y", "İstanbul ﬁn 'S don't", " z　q"]:
        assert np.frombuffer(ids.texts([text])[0], "<u2").tolist() == expected(path, [text])[0][:-1]


def test_round_trip_offsets_and_mixture(odd, odd_rows):
    path = tokenizer_file("word_bpe_49k.json")
    rows = packing.pack(odd, path, sequence_length=256, segment_windows=4).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    want = sorted(x for ids in expected(path, [r[1] for r in odd_rows]) for x in ids)
    assert sorted(x for r in rows for x in np.frombuffer(bytes(r.ids), "<u4").tolist()) == want
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0
    whole = expected(path, [next(r[1] for r in odd_rows if r[0] == 40)])[0]
    own = sorted((r for r in rows if r.doc_id == 40), key=lambda r: r.start)
    assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist() == whole


def test_every_window_has_the_target_mixture():
    before, offsets = packing.round_robin(np.array([10_000, 300, 7, 5_000]), 1024)
    gives = np.diff(before, axis=0)
    full = gives[: 15_307 // 1024]
    ideal = 1024 * np.array([10_000, 300, 7, 5_000]) / 15_307
    assert (gives >= 0).all() and gives.sum(0).tolist() == [10_000, 300, 7, 5_000] and (full.sum(1) == 1024).all()
    assert np.abs(full - ideal).max() <= 2 and np.abs(np.cumsum(full, 0) - np.outer(np.arange(1, len(full) + 1), ideal)).max() <= 2


def test_weights_and_empty_table(odd, none, odd_rows):
    path = tokenizer_file("word_bpe_49k.json")
    assert packing.pack(none, path).count() == 0
    rows = packing.pack(odd, path, sequence_length=128, weights={"src0": 3.0}, segment_windows=8).collect()
    assert sum(r.length for r in rows) == sum(map(len, expected(path, [r[1] for r in odd_rows])))
    assert packing.taken_by(60, [100, 20, 30], [1, 1, 1]) == [20, 20, 20] and packing.taken_by(150, [100, 20, 30], [1, 5, 1]) == [100, 20, 30]
    with pytest.raises(ValueError):
        packing.pack(odd, path, sequence_length=100)
