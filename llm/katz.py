"""Language-model scoring: a bigram model with Katz backoff and Good-Turing discounts.

    p(w | h) = d(c(h, w)) c(h, w) / c(h)     if the pair was seen in training
               alpha(h) p(w)                 otherwise
    p(w)     = d(c(w)) c(w) / N              if the word was seen
               what the discounts leave      otherwise (one class of unknown words)

``alpha(h)`` is what the discounts leave after h, divided by the probability of the
words not seen after h, so that every distribution sums to one. Words are known by a
64-bit hash of their bytes, pairs by a hash of the two; a text begins after a mark and
ends with one, and the latter is a token.

The corpus is one table of chunks, each the texts of some two million tokens as numbers
into the chunk's own dictionary. A chunk asks for what it needs to know, and each
question is asked once per chunk: its different words and pairs, sorted, go to the
partitions that own these hashes, with the chunk's own counts. There the counts of all
chunks are added up, and every chunk gets the totals for what it asked, in the same
order. So counting and looking up are one exchange, a word or pair that is a third of
the corpus is one entry per chunk, and no table is broadcast or held whole anywhere. The
discounted and backed-off mass of each history goes the same way.

Chunks are written bucketed by their number, so that answers come to them and they
are not moved again. Only counts of counts come to the driver.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.sources.scratch import keep, new_path

from .common import column, word_blocks

#: Tokens of a chunk, and different words and pairs that a partition adds up.
CHUNK, ENTRIES = 1 << 21, 1 << 20
#: Good-Turing discounts up to this count; higher counts are trusted.
LARGEST = 5
# No word holds a space: these stand for the marks.
_BEGIN, _END = b" begin", b" end"
_WORDS, _PAIRS = 1, 2


# Numbers as bytes: planes of equal significance side by side compress well.


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.char.encode() + np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


# Chunks.

_CHUNK = (
    "chunk bigint, tokens bigint, distinct bigint, uid array<bigint>, key array<bigint>, training array<boolean>, "
    "length array<bigint>, before array<bigint>, words binary, ids binary"
)


def _chunks(df: DataFrame, key: str, text: str, training: Column, size: int) -> DataFrame:
    """Texts as numbers. A text is one piece, or several if it is long; each piece has the
    row's own number (uid), its key, its number of tokens, and the word before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = made = 0

        def fresh():
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            for mark in (_BEGIN, _END):
                numbers[mark]
            return numbers, [], []

        def chunk_of() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], dtype=np.uint64)
            counts = np.bincount(flat, minlength=len(hashes))
            order = np.lexsort((hashes, -counts))
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            uid, keys, train, length, before = zip(*pieces)
            values = [
                [part << 32 | made], [len(flat)], [len(hashes)], [uid], [keys], [train], [length],
                [place[list(before)].tolist()], [_pack_keys(hashes[order])], [_pack(place[flat])],
            ]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.bool_())] + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
            names = [field.split()[0] for field in _CHUNK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

        numbers, ids, pieces = fresh()
        held = 0
        for batch in batches:
            for k, body, train in zip(*[column(batch, c) for c in ("key", "text", "training")]):
                rows += 1
                last = _BEGIN
                blocks = word_blocks(body, carry=0, fold=True)
                block = next(blocks)
                while block is not None:
                    following = next(blocks, None)
                    if following is None:
                        block.append(_END)
                    if block:
                        before = numbers[last]
                        ids.append(np.fromiter(map(numbers.__getitem__, block), dtype=np.int32, count=len(block)))
                        pieces.append((part << 40 | rows, k, bool(train), len(block), before))
                        held += len(block)
                        last = block[-1]
                    if held >= size:
                        yield chunk_of()
                        made, held = made + 1, 0
                        numbers, ids, pieces = fresh()
                    block = following
        if held:
            yield chunk_of()

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    spark = df.sparkSession
    made = rows.mapInArrow(run, _CHUNK)
    name = f"lm_chunks_{uuid.uuid4().hex}"
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made.write.bucketBy(buckets, "chunk").option("path", new_path(spark, "lm_chunks")).saveAsTable(name)
    return spark.table(name)


class _Chunk:
    """A chunk, decoded: dictionary, tokens, histories (numbers into the dictionary), pairs."""

    def __init__(self, row: dict):
        self.words = _unpack_keys(row["words"])
        self.ids = _unpack(row["ids"])
        self.length = np.array(row["length"], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.training = np.repeat(np.array(row["training"], dtype=bool), self.length)
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[self.first] = row["before"]
        self.by_hash = np.argsort(self.words)

    def pairs(self) -> np.ndarray:
        """The hash of each token with the word before it."""
        mixed = self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.ids]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ mixed >> np.uint64(32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# Questions and answers.

_ASKED = "level int, bucket int, chunk bigint, keys binary, first binary, second binary"
_ANSWER = "level int, bucket int, chunk bigint, first binary, second binary, counts array<bigint>"


def _split(level: int, chunk: int, keys: np.ndarray, first: np.ndarray, second: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Sorted keys and what comes with them, cut into equal ranges of the hash (under 2**32 of
    them). The work grows with the keys, not with the ranges."""
    place = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))).tolist() if len(keys) else []
    rows = [
        (level, int(place[a]), chunk, _pack_keys(keys[a:b]), _pack(first[a:b]), None if second is None else _pack(second[a:b]))
        for a, b in zip(cuts, [*cuts[1:], len(keys)])
    ]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [field.split()[0] for field in _ASKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)


def _ask_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """The different words and pairs of each chunk, with their counts in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row)
            counts = np.bincount(chunk.ids[chunk.training], minlength=len(chunk.words))
            yield _split(_WORDS, row["chunk"], chunk.words[chunk.by_hash], counts[chunk.by_hash].astype(np.uint32), None, buckets)
            pairs = chunk.pairs()
            keys = _distinct(np.sort(pairs))
            seen, times = np.unique(pairs[chunk.training], return_counts=True)
            counts = np.zeros(len(keys), dtype=np.uint32)
            counts[np.searchsorted(keys, seen)] = times
            yield _split(_PAIRS, row["chunk"], keys, counts, None, buckets)

    return chunks.mapInArrow(run, _ASKED)


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _by_partition(asked: DataFrame, answer) -> DataFrame:
    """Bring the questions of all chunks about a range of hashes together and answer them.

    ``answer(keys, firsts, seconds)`` gets lists with one array per chunk and returns the
    two answers for each of them, and counts of counts.
    """

    def answers(place: tuple[int, int], rows: list[dict]) -> pa.RecordBatch:
        keys = [_unpack_keys(r["keys"]) for r in rows]
        firsts = [_unpack(r["first"]) for r in rows]
        seconds = [_unpack(r["second"]) if r["second"] is not None else None for r in rows]
        found, counts = answer(keys, firsts, seconds)
        out = [
            (*place, r["chunk"], _pack(a), None if b is None else _pack(b), None) for r, (a, b) in zip(rows, found)
        ]
        out.append((*place, None, None, None, counts))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = [field.split()[0] for field in _ANSWER.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []
        for row in _rows(batches):
            here = row["level"], row["bucket"]
            if here != place and rows:
                yield answers(place, rows)
                rows = []
            place = here
            rows.append(row)
        if rows:
            yield answers(place, rows)

    return asked.repartition("level", "bucket").sortWithinPartitions("level", "bucket", "chunk").mapInArrow(run, _ANSWER)


def _total_counts(keys: list, firsts: list, seconds: list):
    """For each chunk the total counts, times four, plus one if this chunk is to speak for the
    entry (the first with it in a training text) and two if another chunk has the entry."""
    every = _distinct(np.sort(np.concatenate(keys)))
    total, owner, chunks = np.zeros(len(every), dtype=np.int64), np.full(len(every), -1), np.zeros(len(every), dtype=np.int32)
    places = [np.searchsorted(every, own) for own in keys]
    for number, (place, counts) in enumerate(zip(places, firsts)):
        total[place] += counts
        chunks[place] += 1
        first = place[(counts > 0) & (owner[place] < 0)]
        owner[first] = number
    known = total[total > 0]
    of_counts = np.bincount(np.minimum(known, LARGEST + 2), minlength=LARGEST + 3)
    found = [
        ((total[place] << 2 | (chunks[place] > 1) << 1 | (owner[place] == number)).astype(np.uint64), None) for number, place in enumerate(places)
    ]
    return found, [int(known.sum()), len(known), *of_counts[1 : LARGEST + 2].tolist()]


def _total_mass(keys: list, firsts: list, seconds: list):
    """For each chunk the sums of both masses over all chunks."""
    every = _distinct(np.sort(np.concatenate(keys)))
    one, two = np.zeros(len(every)), np.zeros(len(every))
    places = [np.searchsorted(every, own) for own in keys]
    for place, a, b in zip(places, firsts, seconds):
        one[place] += a
        two[place] += b
    return [(one[place], two[place]) for place in places], []


def _answered(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each chunk with its answers. The chunks stay where they are: they are bucketed."""
    joined = chunks
    for number, answer in enumerate(answers):
        own = answer.where(F.col("chunk").isNotNull()).groupBy("chunk").agg(
            F.array_sort(F.collect_list(F.struct("level", "bucket", "first", "second"))).alias(f"answer{number}")
        )
        joined = joined.join(own, "chunk", "left")
    return joined


def _gathered(answers: list[dict] | None, level: int, name: str, kind) -> np.ndarray:
    """The answers to one question, in the order it was asked."""
    parts = [_unpack(a[name]) for a in answers or [] if a["level"] == level]
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind)


# The model.


@dataclass(frozen=True)
class Discounts:
    """Counts of one level: tokens, different entries, how many entries have counts 1 to 5,
    and the factor of each of these counts."""

    tokens: int
    entries: int
    of_counts: tuple[int, ...]
    factors: tuple[float, ...]

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, *self.factors, 1.0])
        return counts * table[np.minimum(counts, LARGEST + 1)]

    @property
    def left(self) -> float:
        """The tokens that the discounts leave to what was not seen."""
        return sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(self.of_counts, self.factors), start=1))


def good_turing(tokens: int, entries: int, of_counts: list[int]) -> Discounts:
    """Katz's factors for counts 1 to 5 from the counts of counts 1 to 6.

    d(r) = (r*/r - A) / (1 - A), r* = (r + 1) n(r + 1) / n(r), A = 6 n(6) / n(1). Repeated texts
    make the raw counts of counts uneven; if a factor is outside 0..1, n(r) is replaced by the
    line through log n(r) over log r (Gale and Sampson 1995). Only where that does not
    fall steeply enough either, in the smallest corpora, is half a count taken off instead.
    """
    factors = _factors(of_counts)
    if factors is None:
        some = [(np.log(r), np.log(n)) for r, n in enumerate(of_counts, start=1) if n > 0]
        if len(some) > 1:
            slope, level = np.polyfit(*zip(*some), 1)
            factors = _factors([float(np.exp(level) * r**slope) for r in range(1, LARGEST + 2)])
    if factors is None:
        factors = tuple((r - 0.5) / r for r in range(1, LARGEST + 1))
    return Discounts(tokens, entries, tuple(of_counts[:LARGEST]), factors)


def _factors(of_counts: list) -> tuple[float, ...] | None:
    """Katz's factors, or None if one of them is outside 0..1."""
    if any(n <= 0 for n in of_counts) or (rest := (LARGEST + 1) * of_counts[LARGEST] / of_counts[0]) >= 1:
        return None
    factors = tuple(
        float(((r + 1) * of_counts[r] / of_counts[r - 1] / r - rest) / (1 - rest)) for r in range(1, LARGEST + 1)
    )
    return factors if all(0 < d <= 1 for d in factors) else None


def _discounts(answers: DataFrame, level: int) -> Discounts:
    at = lambda i: F.sum(F.get("counts", F.lit(i))).alias(f"c{i}")
    sums = answers.where(F.col("chunk").isNull() & (F.col("level") == level)).agg(*[at(i) for i in range(LARGEST + 3)]).first()
    values = [int(v or 0) for v in sums]
    return good_turing(values[0], values[1], values[2:])


def word_probability(counts: np.ndarray, words: Discounts) -> np.ndarray:
    """p(w) by count. Without any discount to share out, unknown words are one token more."""
    left, tokens = (words.left, words.tokens) if words.left > 0 else (1.0, words.tokens + 1)
    return np.where(counts > 0, words.discounted(counts), left) / max(left, tokens)


def backoff(follows: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the pairs of a history are divided by, and its backoff weight.

    ``follows`` tokens come after the history, ``mass`` is what its pairs keep of them, and
    ``lower`` the probability of their words. A history whose pairs keep everything makes
    room for one more token; one never seen backs off with weight one.
    """
    full = follows - mass <= 1e-9 * follows
    total = np.where(full, follows + 1.0, follows)
    return total, np.where(follows > 0, (total - mass) / total / (1.0 - lower), 1.0)


class _Known:
    """What a chunk knows after the first answers: counts of its words and pairs."""

    def __init__(self, row: dict, words: Discounts):
        self.chunk = chunk = _Chunk(row)
        raw = np.empty(len(chunk.words), dtype=np.uint64)
        raw[chunk.by_hash] = _gathered(row["answer0"], _WORDS, "first", np.uint64)
        self.count, self.elsewhere = (raw >> np.uint64(2)).astype(np.int64), (raw & np.uint64(2)) != 0
        self.p = word_probability(self.count, words)
        # A token follows each word of a text, and one follows the mark before the text.
        begin, end = (np.uint64(xxhash.xxh64_intdigest(mark)) for mark in (_BEGIN, _END))
        self.follows = np.where(chunk.words == begin, self.count[chunk.words == end].sum(), self.count)
        self.follows[chunk.words == end] = 0
        hashes = chunk.pairs()
        keys = _distinct(np.sort(hashes))
        self.pair = np.searchsorted(keys, hashes)
        raw = _gathered(row["answer0"], _PAIRS, "first", np.uint64)
        self.pair_count, self.speaks = (raw >> np.uint64(2)).astype(np.int64), (raw & np.uint64(1)) != 0

    def masses(self, pairs: Discounts) -> tuple[np.ndarray, np.ndarray]:
        """For each word as a history, the mass its pairs keep and the probability of their
        words, over the pairs this chunk speaks for."""
        token = np.empty(len(self.pair_count), dtype=np.int64)
        token[self.pair] = np.arange(len(self.pair))
        own = (self.pair_count > 0) & self.speaks
        history, word = self.chunk.before[token[own]], self.chunk.ids[token[own]]
        size = len(self.chunk.words)
        # Without any pair, bincount would give whole numbers.
        return (
            np.bincount(history, weights=pairs.discounted(self.pair_count[own]), minlength=size).astype(np.float64),
            np.bincount(history, weights=self.p[word], minlength=size).astype(np.float64),
        )


def _ask_masses(known: DataFrame, words: Discounts, pairs: Discounts, buckets: int) -> DataFrame:
    """Both masses of the histories that other chunks have as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            state = _Known(row, words)
            shared = state.chunk.by_hash[state.elsewhere[state.chunk.by_hash]]
            if len(shared):
                mass, lower = state.masses(pairs)
                yield _split(_WORDS, row["chunk"], state.chunk.words[shared], mass[shared], lower[shared], buckets)

    return known.mapInArrow(run, _ASKED)


_SCORED = "uid bigint, key bigint, training boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _scores(known: DataFrame, words: Discounts, pairs: Discounts) -> DataFrame:
    """Sums over the tokens of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            state = _Known(row, words)
            chunk = state.chunk
            mass, lower = state.masses(pairs)
            shared = chunk.by_hash[state.elsewhere[chunk.by_hash]]
            if len(shared):
                mass[shared] = _gathered(row["answer1"], _WORDS, "first", np.float64)
                lower[shared] = _gathered(row["answer1"], _WORDS, "second", np.float64)
            total, weight = backoff(state.follows.astype(np.float64), mass, lower)
            seen = state.pair_count[state.pair]
            likely = np.where(
                seen > 0, pairs.discounted(seen) / np.maximum(total[chunk.before], 1.0), weight[chunk.before] * state.p[chunk.ids]
            )
            base = np.log10((state.count + 0.5) / (words.tokens + 0.5 * (words.entries + 1)))
            sums = lambda values: np.add.reduceat(values, chunk.first)
            values = [
                row["uid"], row["key"], row["training"], chunk.length, sums((state.count > 0)[chunk.ids].astype(np.int64)),
                sums(base[chunk.ids]), sums(np.log10(likely)),
            ]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = [field.split()[0] for field in _SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

    return known.mapInArrow(run, _SCORED)


def score(df: DataFrame, training: Column, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, entries: int = ENTRIES) -> DataFrame:
    """Score all texts by the model of those where ``training`` holds.

    One row per input row: the key (bigint), training, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (add-half unigrams) and score, both log10. Tokens
    are the words with A-Z in lower case, and one end. A null text is empty; it has the
    end alone. A null ``training`` is false; without any training text all words are
    unknown and have probability one. Other columns of the input are not read.
    """
    chunks = _chunks(df, key, text, training, chunk)
    buckets = max(1, -(-int(chunks.agg(F.sum("tokens").alias("n")).first().n or 0) // entries))
    counts = keep(_by_partition(_ask_counts(chunks, buckets), _total_counts), "lm_counts")
    words, pairs = _discounts(counts, _WORDS), _discounts(counts, _PAIRS)
    masses = keep(_by_partition(_ask_masses(_answered(chunks, counts), words, pairs, buckets), _total_mass), "lm_masses")
    scored = _scores(_answered(chunks, counts, masses), words, pairs)
    return (
        scored.groupBy("uid", "key", "training")
        .agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
        .select(F.col("key").alias(key), "training", "n_tokens", "n_known", F.lit(words.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    )
