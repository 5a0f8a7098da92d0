"""Phrase collocations: counts by broadcast double-array tries, scores by the weakest cut.

Texts become shards: one row per task and language, with the words as numbers into the
shard's own list of words and a mark wherever a piece ends. Between shards a word goes by
a 64-bit hash of language and word, so that no list of all words is held anywhere. Two
words with one hash would spoil the counts: all words are looked through for that, and
another hash is taken if it happens.

Then, for phrases of one word, two words and so on: the candidates are cut in blocks of
bounded size, a task makes a double-array trie of each block, and the tries are broadcast
one after the other. For each trie a shard advances the states of all its positions at
once, level by level, and counts the accepting ones by ``bincount``; Spark sums the
counts of the shards. In the same pass an accepted phrase is prolonged by the word that
follows it, if the phrase that begins one word later is a candidate as well; those that are
prolonged often enough are the next candidates. Every part of them is frequent, and no
other phrase can reach the threshold. Whether a phrase is a candidate is looked up in a
bitmap of its hash, of a fixed size: it may say yes too often, which costs time only.

A broadcast is one trie, of at most about ``block`` phrases; the number of passes grows
with the candidates. Nothing else comes to the driver but counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.sources.scratch import keep

from . import double_array
from .common import column
from .phrase_words import END, OpenShard, slots_of, token_blocks, word_names

#: Words of a phrase, and the least number of occurrences.
LONGEST, LEAST = 4, 30
#: A phrase goes if a longer one has so many hundredths of its occurrences.
COVERED = 80
#: A cut's score is this many times a / (l + r); results per language.
SCALE, TOP = 2_000_000, 2000
#: Tokens of a shard, characters that are split at a time, phrases of a trie.
SHARD, BLOCK_CHARS, BLOCK = 1 << 20, 1 << 20, 1 << 19
#: Positions of a shard that are looked at together, rows of counts that are handed over together.
POSITIONS, ROWS = 1 << 17, 1 << 16
#: Texts that are handed to Python together: a batch is held several times, in the JVM too.
TEXTS = 256
#: The bitmap of candidates has 2 to the power of so many bits.
FILTER_BITS = 26
UNKNOWN = "und"
#: Goes into the words' hashes, with a number that changes if two words have the same.
SALT = "words "

_SHARD = "lang string, tokens long, own long, words array<binary>, counts array<long>, names binary, ids binary"


def _keep_by(rows: int, df: DataFrame, name: str) -> DataFrame:
    """``keep``, with so many rows in a batch for Python."""
    conf, setting = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(setting)
    conf.set(setting, rows)
    try:
        return keep(df, name)
    finally:
        conf.set(setting, before)


def _shards(df: DataFrame, text: str, lang: str, size: int, longest: int, salt: str) -> DataFrame:
    """Every token is the first of phrases in just one shard; a shard that ends inside a
    text has some tokens beyond its own, which the next shard begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        open_: dict[str, OpenShard] = {}

        def closed(name: str, beyond: int) -> pa.RecordBatch:
            shard = open_.pop(name)
            ids = np.concatenate(shard.ids)
            own = len(ids) - beyond
            counts = np.bincount(ids[:own], minlength=len(shard.numbers))
            names = word_names(salt, name, shard.numbers)
            values = [[name], [int(own - counts[0])], [own], [list(shard.numbers)], [counts.tolist()], [names.tobytes()], [ids.tobytes()]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in _SHARD.split(", ")])

        for batch in batches:
            for name, body in zip(column(batch, "lang"), column(batch, "text")):
                last: list[bytes] = []
                for words in token_blocks(body, BLOCK_CHARS):
                    if held >= size:
                        # Room for more: what a phrase may reach beyond its first token goes on in a new shard.
                        for other in list(open_):
                            if other != name:
                                yield closed(other, 0)
                        if name in open_:
                            yield closed(name, len(last))
                            open_[name] = OpenShard(last)
                        held = len(last)
                    open_.setdefault(name, OpenShard()).add(words)
                    held += len(words)
                    last = (last + words)[-(longest - 1) :] if longest > 1 else []
                if name in open_:
                    open_[name].add([END])
                    held += 1
        for name in list(open_):
            yield closed(name, 0)

    rows = df.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))
    return _keep_by(TEXTS, rows.mapInArrow(run, _SHARD), "phrase_shards")


def _counted_words(df: DataFrame, text: str, lang: str, size: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Shards, and all words with their names and counts: lang, word, name, n."""
    for number in itertools.count():
        salt = f"{SALT}{number}"
        shards = _shards(df, text, lang, size, longest, salt)
        entries = shards.select("lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry")).where("at > 0")
        words = entries.groupBy("lang", F.col("entry.words").alias("word")).agg(F.sum("entry.counts").alias("n"))
        named = keep(words.withColumn("name", F.xxhash64(F.lit(salt), "lang", "word")), "phrase_words")
        if named.groupBy("name").count().where("count > 1").isEmpty():
            return shards, named


def _tries(candidates: DataFrame, depth: int, blocks: int) -> DataFrame:
    """A packed trie for each block of candidates."""
    names = [f"w{m}" for m in range(1, depth + 1)]
    dealt = candidates.select(F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int").alias("block"), "name", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
            rows = pa.Table.from_batches(rows)
            phrases = np.stack([rows.column(w).to_numpy() for w in names], axis=1)
            trie = double_array.build(phrases, rows.column("name").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([trie.packed()], pa.binary())], names=["block", "trie"])

        here, held = None, []
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and block[a] != here:
                    yield made(held, here)
                    held = []
                here = int(block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield made(held, here)

    return keep(dealt.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, "block int, trie binary"), "phrase_tries")


def _bitmap(candidates: DataFrame, depth: int, bits: int) -> np.ndarray:
    """Words of 64 bits, in which the bits of all candidates are set. Its size is fixed."""
    columns = [f"w{m}" for m in range(1, depth + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = slots_of([batch.column(m).to_numpy() for m in range(depth)], bits)
            values = (slots >> np.uint64(6)).view(np.int64), (np.uint64(1) << (slots & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["place", "bits"])

    found = candidates.select(*columns).mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.int64)
    bitmap[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return bitmap.view(np.uint64)


def _pass(shards: DataFrame, trie, step: int, candidates, bits: int, prolong: bool, least: int) -> DataFrame:
    """Over all shards: occurrences of each phrase of the trie (next null), and of each phrase
    with a word after it, where the phrase from its second word on may be a candidate; counts
    of ``least`` and more.

    Phrase and word share one number, which shuffles in few bytes: the phrase's place times
    ``step`` (one more than the trie's words), plus the word's symbol and one; nothing is added
    for a phrase without a next word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bitmap = trie.value, candidates.value
        depth = known.depth
        for batch in batches:
            for i in range(batch.num_rows):
                own, names, ids = (batch.column(k)[i] for k in range(3))
                names = np.frombuffer(names.as_buffer(), dtype=np.int64)
                ids = np.frombuffer(ids.as_buffer(), dtype=np.int32)
                of_word = known.symbols(names)
                of_word[0] = -1  # the end of a piece
                counts, keys = np.zeros(len(known.names), dtype=np.int64), []
                # A slice of positions at a time, so that a long shard needs little memory.
                for start in range(0, own.as_py(), POSITIONS):
                    stop = min(own.as_py(), start + POSITIONS)
                    at, phrase = known.accept(of_word[ids[start : stop + depth - 1]], stop - start)
                    counts += np.bincount(phrase, minlength=len(counts))
                    if not prolong:
                        continue
                    at += start
                    inside = at + depth < len(ids)
                    at, phrase = at[inside], phrase[inside]
                    slots = slots_of([names[ids[at + m]] for m in range(1, depth + 1)], bits)
                    following = ids[at + depth]
                    safe = (following > 0) & (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)
                    keys.append(phrase[safe] * np.int64(len(names)) + following[safe])
                seen = np.flatnonzero(counts)
                yield from counted(seen * step, None, counts[seen])
                if keys:
                    keys, times = np.unique(np.concatenate(keys), return_counts=True)
                    phrase, following = np.divmod(keys, len(names))
                    symbol = of_word[following]
                    # A word without a symbol in this trie goes by its name.
                    yield from counted(phrase * step + symbol + 1, pa.array(names[following], pa.int64(), mask=symbol >= 0), times)

    def counted(key: np.ndarray, after: pa.Array | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(key), ROWS):
            part = key[start : start + ROWS]
            name = pa.nulls(len(part), pa.int64()) if after is None else after.slice(start, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), name, pa.array(n[start : start + ROWS], pa.int64())], names=["key", "next", "n"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trie.value
        for batch in batches:
            phrase, symbol = np.divmod(batch.column(0).to_numpy(), step)
            of_symbol = pa.array(known.words[np.maximum(symbol - 1, 0)], pa.int64(), mask=symbol == 0)
            names = pa.array(known.names[phrase], pa.int64())
            yield pa.RecordBatch.from_arrays([names, pc.coalesce(of_symbol, batch.column(1)), batch.column(2)], names=["name", "next", "n"])

    rows = shards.select("own", "names", "ids").mapInArrow(run, "key long, next long, n long")
    summed = rows.groupBy("key", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # A row is a whole shard: one at a time goes to Python, not all of a task.
    summed = _keep_by(1, summed, "phrase_sums")
    return summed.mapInArrow(spelled, "name long, next long, n long")


def phrase_counts(shards: DataFrame, words: DataFrame, longest: int, least: int, block: int, bits: int = FILTER_BITS) -> list[DataFrame]:
    """For each number of words the frequent phrases: w1, w2, ... (names of words) and f."""
    spark = shards.sparkSession
    candidates = keep(words.where(F.col("n") >= least).select("name", F.col("name").alias("w1")), "phrase_candidates")
    found = []
    for depth in range(1, longest + 1):
        names = [f"w{m}" for m in range(1, depth + 1)]
        n = candidates.count()
        blocks = max(1, -(-n // block))
        counted = []
        tries = _tries(candidates, depth, blocks) if n else None
        bitmap = spark.sparkContext.broadcast(_bitmap(candidates, depth, bits) if depth < longest else None)
        for number in range(blocks if n else 0):
            row = tries.where(F.col("block") == number).first()
            if row is None:
                continue
            known = double_array.Trie.read(row.trie)
            trie = spark.sparkContext.broadcast(known)
            counts = _pass(shards, trie, len(known.words) + 1, bitmap, bits, depth < longest, least)
            counted.append(keep(counts, "phrase_counts"))
            trie.destroy()
        bitmap.destroy()
        if counted:
            counts = reduce(DataFrame.unionByName, counted)
        else:
            counts = spark.createDataFrame([], "name long, next long, n long")
        frequent = counts.where(F.col("next").isNull())
        found.append(keep(candidates.join(frequent, "name").select(*names, F.col("n").alias("f")), "phrase_frequent"))
        if depth < longest:
            longer = candidates.join(counts.where("next is not null").select("name", "next"), "name")
            # Written, so that the numbers that name the phrases stay.
            longer = longer.select(F.monotonically_increasing_id().alias("name"), *names, F.col("next").alias(f"w{depth + 1}"))
            candidates = keep(longer, "phrase_candidates")
    return found


def _joined(phrases: DataFrame, counts: list[DataFrame], first: int, size: int, name: str) -> DataFrame:
    """Adds the count of the phrase of ``size`` words that begins at word ``first``."""
    part = counts[size - 1].select(*[F.col(f"w{m}").alias(f"w{first + m - 1}") for m in range(1, size + 1)], F.col("f").alias(name))
    return phrases.join(part, [f"w{first + m}" for m in range(size)])


def _cut(a: Column, left: Column, right: Column, k: int, scale: int) -> Column:
    """Score, k, l and r of a cut. The product is a decimal of up to 38 digits."""
    product = a.cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    score = F.floor(product / (left + right).cast("decimal(20,0)")).cast("bigint")
    # The quotient may have been rounded up to a whole number.
    score = F.when(score.cast("decimal(10,0)") * (left + right).cast("decimal(20,0)") > product, score - 1).otherwise(score)
    return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of each language's first phrases.

    Texts count in lower case (A-Z), cut at ``.,;:!?`` and line ends into pieces and at spaces
    and tabs into words. ``a`` counts a phrase of 2 to ``longest`` words inside pieces,
    overlaps included, ``n`` all words of the language, ``l`` and ``r`` the two parts of the
    cut with the lowest score (ties: the earliest). Phrases inside a longer one that has
    ``covered`` hundredths of their occurrences are left out. Order: score, a, then the phrase by its
    bytes. A null language is ``und``; null and empty texts have no words; repeated rows count
    as often as they occur. Languages without frequent phrases, and empty tables, give no row.
    Other columns are not read.
    """
    if not 2 <= longest <= 8:
        raise ValueError("phrases have 2 to 8 words")
    shards, words = _counted_words(df, text, lang, shard, longest)
    words = words.where(F.col("n") >= least)
    counts = phrase_counts(shards, words, longest, least, block)
    every = [f"w{m}" for m in range(1, longest + 1)]
    none = F.lit(0).cast("bigint")  # beside the number of words, which tells how many names count
    padded = lambda names: [F.lit(len(names)).alias("words"), *[F.col(w) if w in names else none.alias(w) for w in every]]

    scored, inside = [], []
    for size in range(2, longest + 1):
        own = every[:size]
        rows = counts[size - 1].withColumnRenamed("f", "a")
        for k in range(1, size):
            rows = _joined(rows, counts, 1, k, f"l{k}")
            rows = _joined(rows, counts, k + 1, size - k, f"r{k}")
        cuts = [_cut(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}"), k, SCALE) for k in range(1, size)]
        scored.append(rows.select(*padded(own), "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")))
        for part in range(2, size):
            for first in range(size - part + 1):
                moved = [F.col(w).alias(every[m]) for m, w in enumerate(own[first : first + part])]
                rest = [none.alias(w) for w in every[part:]]
                inside.append(counts[size - 1].select(F.lit(part).alias("words"), *moved, *rest, F.col("f").alias("longer")))
    scored = reduce(DataFrame.unionByName, scored)
    if inside:
        longer = reduce(DataFrame.unionByName, inside).groupBy("words", *every).agg(F.max("longer").alias("longer"))
        scored = scored.join(longer, ["words", *every], "left").where(
            F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered)
        )
    scored = keep(scored.select("words", *every, "a", "cut.score", "cut.l", "cut.r").withColumn("name", F.monotonically_increasing_id()), "phrase_scored")

    names = F.slice(F.array(*every), F.lit(1), F.col("words"))
    spelled = scored.select(F.col("name").alias("phrase_name"), F.posexplode(names).alias("at", "name")).join(words, "name")
    spelled = spelled.groupBy(F.col("phrase_name").alias("name")).agg(
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ").alias("phrase"),
    )
    sizes = shards.groupBy("lang").agg(F.sum("tokens").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.join(spelled, "name").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
