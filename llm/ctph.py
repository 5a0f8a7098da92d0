"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text wherever its value is one less
than a multiple of the block size, so a cut depends on its surroundings alone and an
edit changes only the chunks that it touches. Each chunk gives one character. A
fingerprint is ``block size:chunks at that size:chunks at twice the size``; two
fingerprints are compared by edit distance where they share a block size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import column

#: Chunks of a fingerprint: the block size is the largest with at least half of these.
CHUNKS = 64
_SMALLEST, _WINDOW = 3, 7
#: Unrelated chunks agree by chance; a likeness needs so many in a row in common.
_COMMON = 4
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes that the rolling hash is computed for at a time.
_PIECE = 1 << 20


def _cuts(raw: bytes, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end at block size 3 * 2**lowest, and the last doubling that cuts there too."""
    ends, levels = [], []
    data = np.frombuffer(raw, dtype=np.uint8)
    for start in range(0, len(data), _PIECE):
        head = max(0, start - _WINDOW + 1)
        part = data[head : start + _PIECE].astype(np.uint32)
        rolled = part.copy()
        factor = 1
        for back in range(1, min(_WINDOW, len(part))):
            factor = factor * 0x01000193 & 0xFFFFFFFF
            rolled[back:] += part[: len(part) - back] * np.uint32(factor)
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x2C1B3C6D)
        rolled ^= rolled >> np.uint32(13)
        value = rolled[start - head :].astype(np.int64) + 1
        hit = np.flatnonzero(value % (_SMALLEST << lowest) == 0)
        ends.append(hit + start + 1)
        low_bit = value[hit] & -value[hit]
        levels.append(np.log2(low_bit).astype(np.int64))
    return np.concatenate(ends), np.concatenate(levels)


def _letters(raw: bytes, ends: np.ndarray) -> str:
    """One letter for each chunk; what follows the 63rd is one chunk up to the end."""
    bounds = ends[: CHUNKS - 1].tolist()
    if not bounds or bounds[-1] < len(raw):
        bounds.append(len(raw))
    elif len(ends) >= CHUNKS:
        bounds[-1] = len(raw)
    view, start, found = memoryview(raw), 0, []
    for end in bounds:
        found.append(_LETTERS[zlib.crc32(view[start:end]) & 63])
        start = end
    return "".join(found)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text. Null and empty texts have ``3::``."""
    raw = (text or "").encode()
    if not raw:
        return f"{_SMALLEST}::"
    level = 0
    while (_SMALLEST << level) * CHUNKS < len(raw):
        level += 1
    ends, levels = _cuts(raw, max(0, level - 3))
    if level > 3 and (levels >= level - 3).sum() < CHUNKS // 2:
        ends, levels = _cuts(raw, 0)
    while level > 0 and (levels >= level).sum() < CHUNKS // 2:
        level -= 1
    once, twice = _letters(raw, ends[levels >= level]), _letters(raw, ends[levels > level])
    return f"{_SMALLEST << level}:{once}:{twice}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table per step in the bits of a number."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for letter in b:
        equal = where.get(letter, 0)
        diagonal = ((equal & up) + up ^ up) | equal | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & last:
            distance += 1
        elif minus & last:
            distance -= 1
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(diagonal | plus)) & full, plus & diagonal & full
    return distance


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) < _COMMON:
        return 0.0
    grams = {a[i : i + _COMMON] for i in range(len(a) - _COMMON + 1)}
    if not any(b[i : i + _COMMON] in grams for i in range(len(b) - _COMMON + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str | None, b: str | None) -> float:
    """0 (nothing in common, or block sizes that cannot be compared) to 1 (equal)."""
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    size_a, once_a, twice_a = a.split(":")
    size_b, once_b, twice_b = b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    if size_a == size_b:
        return max(_alike(once_a, once_b), _alike(twice_a, twice_b) if twice_a and twice_b else 0.0)
    if size_a == 2 * size_b:
        return _alike(once_a, twice_b)
    if size_b == 2 * size_a:
        return _alike(twice_a, once_b)
    return 0.0


def with_fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column."""
    of = F.pandas_udf(lambda texts: texts.map(fingerprint), T.StringType())
    return df.withColumn(to, of(F.col(text)))


def _slice_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below the key, by two short scans. Null: 0."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]).cast("array<bigint>")
    whole = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    below = F.size(F.filter(coarse, lambda b: b < key))
    rest = F.slice(whole, below * step + 1, F.lit(step))
    return below * step + F.size(F.filter(rest, lambda b: b < key))


def beside_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt and sorted so that each document is followed by the next one.

    Columns: slice, wrap, own, key, text. The documents are cut along the key into
    slices of similar size, and a slice also gets the first document of the slice
    after it (``own`` false; ``wrap`` 1 for the very first document behind the last
    slice). One exchange moves each text once. Null keys come first; documents with
    equal keys follow each other by text. Only the slices' bounds and first keys, a
    few numbers per slice, come to the driver.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    bounds = rows.select(F.percentile_approx("key", shares, 10 * n).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    sliced = rows.select(_slice_of(F.col("key"), bounds).alias("slice") if bounds else F.lit(0).alias("slice"), "key", "text")
    firsts = sorted(
        (r.slice, r.low, r.nulls)
        for r in sliced.groupBy("slice").agg(F.min("key").alias("low"), F.count_if(F.col("key").isNull()).alias("nulls")).collect()
    )
    low, before, previous = [None] * (len(bounds) + 1), [None] * (len(bounds) + 1), None
    for at, first, _ in firsts:
        low[at], before[at], previous = first, previous, at
    array = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    leads = F.col("key") == F.get(array(low), F.col("slice").cast("int"))
    very_first = F.col("key").isNull() if firsts and firsts[0][2] else (leads & (F.col("slice") == (firsts[0][0] if firsts else 0)))
    places = F.array(
        F.struct(F.col("slice").cast("bigint").alias("slice"), F.lit(0).alias("wrap"), F.lit(True).alias("own")),
        F.when(
            leads & F.get(array(before), F.col("slice").cast("int")).isNotNull(),
            F.struct(F.get(array(before), F.col("slice").cast("int")).alias("slice"), F.lit(0).alias("wrap"), F.lit(False).alias("own")),
        ),
        F.when(
            very_first,
            F.struct(F.lit(previous or 0).cast("bigint").alias("slice"), F.lit(1).alias("wrap"), F.lit(False).alias("own")),
        ),
    )
    return (
        sliced.select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("place"), "key", "text")
        .select("place.slice", "place.wrap", "place.own", "key", "text")
        .repartition(n, "slice")
        .sortWithinPartitions("slice", "wrap", F.col("key").asc_nulls_first(), "text")
    )


def edited_by_next(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text edited by the next, and likenesses.

    One row per input row: the key (bigint), n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text is empty; the document
    after the last is the first, which may be the document itself. Texts are read as
    they come, two at a time. Other columns of the input are not read.
    """
    schema = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for place, own, k, body in zip(*[column(batch, c) for c in ("slice", "own", "key", "text")]):
                mark = fingerprint(body)
                if held is not None and held[0] == place and held[1]:
                    _, _, held_key, held_text, held_mark = held
                    edited = edited_by_next(held_text, body)
                    edited_mark = fingerprint(edited)
                    values = (
                        held_key,
                        len(held_text),
                        hashlib.sha256(edited.encode()).hexdigest(),
                        held_mark,
                        edited_mark,
                        likeness(held_mark, edited_mark),
                        likeness(held_mark, mark),
                    )
                    for values_of, value in zip(out, values):
                        values_of.append(value)
                held = (place, own, k, body, mark)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=names)

    return beside_next(df, key, text).mapInArrow(run, schema)
