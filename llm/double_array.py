"""Double-array tries over words, walked by numpy for all text positions at once.

A word is a symbol, and a symbol is a fixed number of bytes, so that a node has at most 256
children and finds room quickly. From state s the byte c leads to t = base[s] + c, if
check[t] == s. All phrases of a trie have the same number of words, so the states reached
with the last byte are the accepting ones; they know the number of their phrase.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import zstandard

#: Bases that are tried at a time for a node with several children.
_WINDOW = 4096


@dataclass
class Trie:
    #: The words' ids in ascending order; a word's symbol is its place.
    words: np.ndarray
    #: Bytes per symbol, words per phrase.
    digits: int
    depth: int
    base: np.ndarray
    check: np.ndarray
    #: Of accepting states the place of the phrase, of others -1.
    phrase: np.ndarray
    #: What the caller calls the phrases.
    names: np.ndarray

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(self, protocol=5))

    @staticmethod
    def read(packed: bytes) -> Trie:
        return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word ids, -1 where the trie does not know the word."""
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == words, at, -1) if len(self.words) else np.full(len(words), -1)

    def accept(self, symbols: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions below ``own`` where a phrase begins, and which phrase.

        The states of all positions go forward by one byte at a time; positions without a
        way on are dropped.
        """
        at = np.flatnonzero(symbols[: max(0, min(own, len(symbols) - self.depth + 1))] >= 0)
        state = np.zeros(len(at), dtype=np.int64)
        for level in range(self.depth):
            symbol = symbols[at + level]
            for digit in range(self.digits - 1, -1, -1):
                to = self.base[state] + (symbol >> 8 * digit & 255)
                # An unknown word (-1) leads nowhere, though its lowest bytes are bytes.
                on = (symbol >= 0) & (self.check[to] == state)
                at, state, symbol = at[on], to[on], symbol[on]
        return at, self.phrase[state]


def build(phrases: np.ndarray, names: np.ndarray) -> Trie:
    """The trie of different phrases, one per row, as word ids."""
    words = np.unique(phrases)
    digits = 1
    while len(words) > 1 << 8 * digits:
        digits += 1
    symbols = np.searchsorted(words, phrases)
    keys = np.concatenate([(symbols[:, [m]] >> 8 * d & 255) for m in range(phrases.shape[1]) for d in range(digits - 1, -1, -1)], axis=1)
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    n, steps = keys.shape

    room = 1 << 10
    base, check, used = np.zeros(room, dtype=np.int64), np.full(room, -1, dtype=np.int64), np.zeros(room, dtype=bool)
    used[0] = True  # the root
    start_of: dict[int, int] = {}

    def grow(least: int) -> None:
        nonlocal base, check, used
        more = max(least + 1 - len(base), len(base))
        if least >= len(base):
            base, check = np.pad(base, (0, more)), np.pad(check, (0, more), constant_values=-1)
            used = np.pad(used, (0, more))

    def place(children: np.ndarray) -> int:
        """A base from which all children fall on free states; crowded ones are not tried again."""
        kind = len(children).bit_length()
        start = start_of.get(kind, 1)
        while True:
            grow(start + _WINDOW + 256)
            free = ~used[start + children[0] : start + children[0] + _WINDOW]
            for c in children[1:]:
                free = free & ~used[start + c : start + c + _WINDOW]
            found = int(free.argmax())
            if free[found]:
                start_of[kind] = start + found
                return start + found
            start += _WINDOW

    # Rows of the same prefix are neighbours; ``node`` is the state of each row's prefix.
    node = np.zeros(n, dtype=np.int64)
    for step in range(steps):
        key = keys[:, step]
        new_child = np.ones(n, dtype=bool)
        new_child[1:] = (node[1:] != node[:-1]) | (key[1:] != key[:-1])
        child_of = np.cumsum(new_child) - 1
        parents, children = node[new_child], key[new_child]
        cuts = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1], [True])))
        sizes = np.diff(cuts)
        state_of = np.empty(len(children), dtype=np.int64)
        # Many children first, while there is room; single children go wherever a state is free.
        for i in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            a, b = cuts[i], cuts[i + 1]
            to = place(children[a:b]) + children[a:b]
            used[to] = True
            base[parents[a]], check[to], state_of[a:b] = to[0] - children[a], parents[a], to
        single = cuts[:-1][sizes == 1]
        if len(single):
            free = np.flatnonzero(~used)
            if len(free) < len(single):
                last = len(used)
                grow(last + len(single) - len(free))
                free = np.flatnonzero(~used)
            to = free[: len(single)]
            used[to] = True
            base[parents[single]], check[to], state_of[single] = to - children[single], parents[single], to
        node = state_of[child_of]
    # Every step from any state stays inside the arrays: bases are at least -255, which wraps to the end.
    top = int(np.flatnonzero(used).max()) + 1
    grow(top + 512)
    phrase = np.full(len(base), -1, dtype=np.int64)
    phrase[node] = order
    end = top + 512
    return Trie(words, digits, phrases.shape[1], base[:end].astype(np.int32), check[:end].astype(np.int32), phrase[:end].astype(np.int32), names)
