"""What the tasks of collocation mining run: words of texts, shards in the making, bits of phrases.

Kept apart from the plans, so that a Python worker imports little beside numpy.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

# 0xFF is in no UTF-8 text: it stands for the end of a piece.
END = b"\xff"
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + END * 10)
_GAP = re.compile(rb"[\x20\x09\xff]")


def token_blocks(text: bytes | None, chars: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text in lower case, and 0xFF where a piece ends, in lists of bounded length.

    Once the ends of pieces are replaced, space and tab are the only white space left
    that ``split`` knows.
    """
    folded, start = (text or b"").translate(_FOLDED), 0
    while start < len(folded):
        cut = _GAP.search(folded, start + chars) if len(folded) - start > chars else None
        end = cut.start() if cut else len(folded)
        yield folded[start:end].replace(END, b" \xff ").split()
        start = end


class OpenShard:
    """A shard in the making. Number 0 is the end of a piece."""

    def __init__(self, before: list[bytes] = ()):
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[END]
        self.ids = []
        self.size = 0
        if before:
            self.add(before)

    def add(self, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words)


def word_names(salt: str, lang: str, words: Iterable[bytes]) -> np.ndarray:
    """The hashes that stand for words; the same as Spark's ``xxhash64`` of salt, language and word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(salt.encode(), 42))
    return np.array([xxhash.xxh64_intdigest(word, seed) for word in words], dtype=np.uint64)


def slots_of(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit that stands for each phrase, given as one array of names per word."""
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for names in columns:
        mixed = (mixed ^ names.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(64 - bits)
