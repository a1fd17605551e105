"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

WORD = 8
SHALLOW_WORDS = 4


class BlindTrie:
    """Strings of one group in a compacted trie whose inner nodes hold only a depth and branching bytes.

    A string walks down by branching bytes alone, is compared once with the leaf it reaches, and enters where they part.
    A string that ends counts as smaller than its extensions.
    """

    def __init__(self):
        self.root: list | int | None = None
        self.strings: list[bytes] = []

    @staticmethod
    def byte(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def add(self, s: bytes) -> None:
        own = len(self.strings)
        self.strings.append(s)
        if self.root is None:
            self.root = own
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(self.byte(s, node[0]), next(iter(node[1].values())))
        other = self.strings[node]
        part = next((i for i, (a, b) in enumerate(zip(s, other)) if a != b), min(len(s), len(other)))
        above, node = None, self.root
        while isinstance(node, list) and node[0] < part:
            above, node = node, node[1][self.byte(s, node[0])]
        if isinstance(node, list) and node[0] == part:
            node[1][self.byte(s, part)] = own
            return
        fork = [part, {self.byte(other, part): node, self.byte(s, part): own}]
        if above is None:
            self.root = fork
        else:
            above[1][self.byte(s, above[0])] = fork

    def sorted(self) -> tuple[list[int], list[int]]:
        """Numbers of the strings in order, and what each shares with the one before it (0 for the first)."""
        order, shared, todo = [], [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            if isinstance(node, list):
                children = [node[1][b] for b in sorted(node[1], reverse=True)]
                todo += [(c, node[0]) for c in children[:-1]]
                todo.append((children[-1], depth))
            else:
                order.append(node)
                shared.append(depth)
        return order, shared


def sort(group: np.ndarray, text: np.ndarray, shallow_words: int = SHALLOW_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of text (a matrix of bytes, filled up with zeros) within each group: the order, and how many bytes each row shares with the one before it (-1 at the begin of a group).

    Multikey quicksort: groups are split by one word of 8 bytes after another, and only rows still tied go on. Below
    shallow_words words, tied rows that differ enter a blind trie per tie; equal rows share all bytes.
    """
    n, width = text.shape
    padded = np.zeros((n, -(-width // WORD) * WORD), np.uint8)
    padded[:, :width] = text
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    shared = np.full(n, -1, np.int64)  # by place
    fresh = np.ones(n, bool)
    fresh[1:] = group[order[1:]] != group[order[:-1]]
    first_of_group = fresh.copy()
    tie = np.cumsum(fresh)  # by place: rows with one number are equal so far
    for w in range(min(shallow_words, words.shape[1])):
        many = np.bincount(tie)[tie] > 1
        at = np.flatnonzero(many)
        if not len(at):
            break
        rows = order[at]
        by = np.lexsort((words[rows, w], tie[at]))
        order[at] = rows[by]
        value = words[order, w]
        split = np.zeros(n, bool)
        split[1:] = (tie[1:] == tie[:-1]) & (value[1:] != value[:-1])
        places = np.flatnonzero(split)
        diff = padded[order[places], w * WORD : (w + 1) * WORD] != padded[order[places - 1], w * WORD : (w + 1) * WORD]
        shared[places] = w * WORD + diff.argmax(axis=1)
        fresh = np.ones(n, bool)
        fresh[1:] = (tie[1:] != tie[:-1]) | split[1:]
        tie = np.cumsum(fresh)
    same = ~fresh
    shared[same] = width
    depth = shallow_words * WORD
    if depth < width and same.any():
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:], n)
        rest = padded[:, depth:]
        unequal = np.zeros(n, bool)
        places = np.flatnonzero(same)
        unequal[places] = (rest[order[places]] != rest[order[places - 1]]).any(axis=1)
        for a, b in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
            if not unequal[a:b].any():
                continue
            rows = order[a:b]
            distinct: dict[bytes, list[int]] = {}
            for r in rows.tolist():
                distinct.setdefault(rest[r].tobytes(), []).append(r)
            trie, keys = BlindTrie(), list(distinct)
            for k in keys:
                trie.add(k)
            out, lcp = [], []
            for i, common in zip(*trie.sorted(), strict=True):
                out += distinct[keys[i]]
                lcp += [min(width, depth + common)] + [width] * (len(distinct[keys[i]]) - 1)
            order[a:b] = out
            shared[a + 1 : b] = lcp[1:]
    shared[first_of_group] = -1
    return order, shared
