"""Texts cut at spaces: counts are the library's, and a repeated word is encoded once."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
_PARTS = [
    "a", "Z", "9", "'s", "'ll", " ", "  ", "\n", " \n", "\t", "\u00a0", "\u0085", "\u2003", "\u200b", "\x1c", "\x00", "\x7f", "\u00e9", "\u4e2d",
    "\U0001f600", "<|endoftext|>", "<|endof", "text|>", ".", "~", " the", " word", "\u0120", "\u3000", "\r\n", "\u0301", "x" * 50,
]


class Seen:
    """The library's tokenizer, noting how many characters it is given."""

    def __init__(self):
        self.inner, self.chars = Tokenizer.from_file(JSON), 0

    def get_vocab(self, **how):
        return self.inner.get_vocab(**how)

    def encode_batch_fast(self, texts, **how):
        self.chars += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **how)


def test_any_characters_count_as_in_the_library():
    draw, library, count = random.Random(3), Tokenizer.from_file(JSON), token_counts._counter(JSON)
    texts = ["".join(draw.choice(_PARTS) for _ in range(draw.randrange(30))) for _ in range(4000)]
    want = [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time many pieces are remembered
        assert [n for i in range(0, 4000, 100) for n in count(texts[i : i + 100])] == want


def test_a_repeated_word_is_encoded_once():
    seen = Seen()
    count = token_counts._by_pieces(seen)
    text = "a word and " * 1000 + "end"
    want = len(seen.inner.encode(text, add_special_tokens=False).ids)
    assert count([text, text]) == [want, want] and seen.chars < 100
    assert count([text]) == [want] and seen.chars < 120


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 1)
    library = Tokenizer.from_file(JSON)
    count = token_counts._by_pieces(library)
    for _ in range(3):
        assert count(["b c d b c d b e", ""]) == [len(library.encode("b c d b c d b e", add_special_tokens=False).ids), 0]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_tokenizers_take_whole_texts(tmp_path, change):
    with open(JSON, "rb") as file:
        about = json.load(file) | change
    other = tmp_path / "other.json"
    other.write_text(json.dumps(about))
    assert token_counts._cuts_at_spaces(JSON) and not token_counts._cuts_at_spaces(str(other))
