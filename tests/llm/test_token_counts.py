import random

import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from periodica.llm import token_counts
from periodica.llm.queries import tokenizer_file


def reference(pieces, byte_pieces):
    """The same vocabulary in an installed unigram tokenizer."""
    least = min(s for _, s in pieces)
    vocabulary = [("<unk>", least), *pieces, *([(f"<0x{b:02X}>", least) for b in range(256)] if byte_pieces else [])]
    out = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_pieces))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)])
    return lambda t: len(out.encode(t, add_special_tokens=False).ids)


def test_random_vocabularies_with_ties():
    random.seed(6)
    for byte_pieces in (False, True):
        for _ in range(40):
            pieces = {"▁": -2.0, "a": -2.0}
            for _ in range(25):
                pieces["".join(random.choice("▁abcé") for _ in range(random.randint(1, 4)))] = float(-random.randint(1, 6))
            count = reference(list(pieces.items()), byte_pieces)
            own = token_counts.UnigramCounter(list(pieces.items()), byte_pieces)
            for _ in range(40):
                text = " ".join("".join(random.choice("abcéxü🙂") for _ in range(random.randint(1, 12))) for _ in range(3))
                assert sum(own[w] for w in text.split()) == count(text), (pieces, text)


def test_whole_texts(spark, odd, odd_rows, none):
    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [(model.id_to_piece(i), model.get_score(i)) for i in range(3, len(model)) if not model.is_byte(i)]
    assert not any("▁" in p.lstrip("▁") for p, _ in plain)
    count = reference(plain, True)
    got = token_counts.count_tokens(odd, path).collect()
    want = [(r[0], len((r[1] or "").split()), count(r[1] or "")) for r in odd_rows]
    assert sorted(((r.doc_id, r.n_words, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: count(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()} == truth
    assert token_counts.count_tokens(none, path).count() == 0
