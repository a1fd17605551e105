"""Token counts: best segmentations by a unigram vocabulary, of which only scores and piece counts are kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from periodica.llm.common import map_frames

#: Characters of the property White_Space, and the sign that opens a word.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD_BEGIN = "▁"
#: Fixed value: an unknown character scores so much below the least piece.
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 400_000


class UnigramCounter(dict):
    """Pieces of a word; a word is asked for once.

    An Aho-Corasick automaton lists every piece that ends at each place. The best path to a place is the one of largest
    score; of equal ones that whose last piece is longest, as tokenizers find it that walk from left to right and
    replace a path only by a better one. An unknown character is an edge only where no piece of this one character
    exists; it counts as its UTF-8 bytes, or, without byte pieces, as one piece for a run of them.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        import ahocorasick

        self.scores = dict(pieces)
        self.byte_pieces = byte_pieces
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = n = self.count(WORD_BEGIN + word)
        return n

    def count(self, text: str) -> int:
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if self.scores:
            for last, match in self.automaton.iter(text):
                ending[last + 1].append(match)
        score, pieces, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, best_size, single = None, 0, False
            for size, own in ending[end]:
                total = own + score[end - size]
                single |= size == 1
                if best is None or total > best or (total == best and size > best_size):
                    best, best_size = total, size
            unknown = None if single else self.unknown + score[end - 1]
            if unknown is not None and (best is None or unknown > best):
                score[end], open_run[end] = unknown, True
                pieces[end] = pieces[end - 1] + (len(text[end - 1].encode("utf-8", "surrogatepass")) if self.byte_pieces else int(not open_run[end - 1]))
            else:
                score[end], pieces[end] = best, pieces[end - best_size] + 1
        return pieces[n]


@lru_cache(maxsize=2)
def counter_of(path: str) -> UnigramCounter:
    """Pieces and scores of a sentencepiece file; bytes, control and unknown pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in plain], sum(map(model.is_byte, ids)) == 256)


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Number of unigram pieces of each whole text of docs (doc_id, text).

    Texts are cut at white space; each word is segmented on its own behind the word sign, since no piece goes beyond it.
    One pass without shuffle: a task keeps counts of the words it has met, up to 400,000.
    Null and blank texts have 0 tokens; null and repeated doc_ids keep a row each; extra columns are ignored; an empty
    table gives no rows. Returns doc_id, n_words, n_tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = counter_of(vocabulary_path)
        for batch in batches:
            split = [[w for w in BLANKS.split(t) if w] if isinstance(t, str) else [] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [len(s) for s in split], "n_tokens": [sum(map(pieces.__getitem__, s)) for s in split]})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_tokens long")
