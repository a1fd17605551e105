import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from periodica.llm.deep_shallow import BlindTrie, sort


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(max_size=13).map(lambda b: bytes(x % 3 for x in b))), min_size=1, max_size=40), st.integers(0, 2))
def test_order_and_shared_bytes(rows, shallow):
    width = 13
    text = np.zeros((len(rows), width), np.uint8)
    for i, (_, s) in enumerate(rows):
        text[i, : len(s)] = np.frombuffer(s, np.uint8)
    group = np.array([g for g, _ in rows])
    order, shared = sort(group, text, shallow)
    keys = [(group[i], text[i].tobytes()) for i in order]
    assert keys == sorted((g, t.tobytes()) for g, t in zip(group, text, strict=True))
    for k in range(len(rows)):
        if k == 0 or keys[k][0] != keys[k - 1][0]:
            assert shared[k] == -1
        else:
            a, b = keys[k][1], keys[k - 1][1]
            assert shared[k] == next((i for i in range(width) if a[i] != b[i]), width)


def test_blind_trie_sorts_prefixes_first():
    trie = BlindTrie()
    words = [b"banana", b"ban", b"", b"bandana", b"anna", b"b"]
    for w in words:
        trie.add(w)
    order, shared = trie.sorted()
    assert [words[i] for i in order] == sorted(words) and shared == [0, 0, 0, 1, 3, 3]
