"""What several operators share: tables, words, held-out folds, batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, for Spark's and Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none.

    Without an argument, ``bytes.split`` splits at space and 0x09 to 0x0D only.
    """
    return (text or "").encode().split()


def folded_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case and every other character kept."""
    return (text or "").encode().lower().split()


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def word_blocks(text: str | None, carry: int, fold: bool = False, chars: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length.

    Each list but the first starts with the last ``carry`` words that came before, so
    that every run of ``carry + 1`` words lies in exactly one list. ``fold`` puts A-Z
    in lower case.
    """
    text, start, last = text or "", 0, []
    split = folded_words if fold else words
    while True:
        cut = _SPACE.search(text, start + chars) if len(text) - start > chars else None
        end = cut.start() if cut else len(text)
        found = last + split(text[start:end])
        yield found
        if not cut:
            return
        start, last = end, found[max(0, len(found) - carry) :] if carry else []


def fold_of(key: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text. A null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def in_groups(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about so many characters; a longer text is alone in its list."""
    group: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if group and held + len(text) > chars:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def column(batch: pa.RecordBatch, name: str) -> Iterator:
    """The values of a column one after the other, so that one text is copied at a time."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()
