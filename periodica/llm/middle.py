"""Fill-in-the-middle: documents as prefix, suffix and middle, cut between tokens whose offsets the tokenizers library gives."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import map_frames

#: Marks before prefix, suffix and middle (fixed values).
MARKS = ("<P>", "<S>", "<M>")
LETTERS = "[A-Za-z]+"
OTHER = re.compile("[^A-Za-z]")
#: The pre-tokenizer takes about so many code points at once: short pieces are split fastest, and long texts take no more memory.
SLICE_CHARS = 500
SLICE_BYTES = 4 << 20


class TokenEnds:
    """Where the tokens `[A-Za-z]+|[^A-Za-z]` of a text end, in code points."""

    def __init__(self) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(LETTERS), "isolated")

    def __call__(self, text: str) -> np.ndarray:
        parts, begin = [np.zeros(0, np.int64)], 0
        while begin < len(text):
            cut = OTHER.search(text, begin + SLICE_CHARS)  # no token goes on over the begin of another character
            end = cut.start() if cut else len(text)
            pieces = self.split.pre_tokenize_str(text[begin:end])
            ends = np.fromiter([e for _, (_, e) in pieces], np.int64, len(pieces))
            sizes = np.diff(ends, prepend=0)
            first = 0 if OTHER.match(text, begin) else 1  # isolated matches and what lies between them take turns
            sizes[1 - first :: 2] = 1  # a match is one token; every code point between two is one
            ones = np.repeat(ends - sizes, sizes) + np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            parts.append(begin + ones)
            begin = end
        return np.concatenate(parts)


def shuffled(docs: DataFrame, rate: int = 90, suffix_first: int = 20, seed: int = 1) -> DataFrame:
    """Documents (doc_id, text) with a middle moved to the end, for training to fill in.

    Tokens are runs of A to Z in either case and single other code points. Four numbers, the first 8-digit groups of the
    hexadecimal SHA-256 of `seed:doc_id`, settle all: the cuts are the first two modulo (tokens + 1), the third modulo 100
    leaves 100 - rate of 100 documents plain, the fourth modulo 100 gives suffix_first of 100 others the form spm
    (`<S>`suffix`<P>`prefix`<M>`middle) instead of psm (`<P>`prefix`<S>`suffix`<M>`middle). Empty texts and those that hold a mark stay plain.

    Null text is empty; a null doc_id counts as an empty word. Repeated rows keep a row each; extra columns are ignored,
    and an empty table gives no rows. Returns doc_id, n (tokens), form, prefix_chars and middle_chars (null if plain), output.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token_ends = TokenEnds()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text if isinstance(text, str) else ""
                word = "" if doc_id is None else str(int(doc_id))
                digits = hashlib.sha256(f"{seed}:{word}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
                ends = token_ends(text)
                n = len(ends)
                if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
                    rows.append((doc_id, n, "plain", None, None, text))
                    continue
                low, high = (int(ends[r - 1]) if r else 0 for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                p, s, m = (mark + part for mark, part in zip(MARKS, (text[:low], text[high:], text[low:high]), strict=True))
                form = "spm" if h4 % 100 < suffix_first else "psm"
                rows.append((doc_id, n, form, low, high - low, (s + p if form == "spm" else p + s) + m))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)

    return map_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", SLICE_BYTES)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: the parts between its marks, in their first order. No mark can begin inside one part and end in another."""
    parts = F.split(output, "|".join(MARKS))
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
