"""Phrase mining: tries against a dictionary, shards and blocks of any size against SQL."""

from __future__ import annotations

import re

import numpy as np
import pytest

from checks.compare import difference
from llm import collocations as c, double_array, queries as q

from . import tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, words, depth", [(1, 5, 1), (38, 5, 3), (2000, 300, 2), (30000, 70000, 1), (20000, 3000, 4)])
def test_trie_is_the_dictionary(n, words, depth):
    draw = np.random.default_rng(n)
    phrases = np.unique(draw.zipf(1.3, size=(n, depth)) % words * 1_000_003, axis=0)
    draw.shuffle(phrases)
    trie = double_array.Trie.read(double_array.build(phrases, np.arange(len(phrases)) + 7).packed())
    text = np.concatenate([phrases[:50].ravel(), draw.choice(np.append(phrases.ravel(), -5), 5000)])
    known = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    runs = [tuple(text[i : i + depth].tolist()) for i in range(len(text) - depth + 1)]
    at, phrase = trie.accept(trie.symbols(text), len(text) - 9)
    want = [(i, known[run]) for i, run in enumerate(runs) if run in known and i < len(text) - 9]
    assert sorted(zip(at.tolist(), phrase.tolist())) == want


@pytest.mark.parametrize("chars", [1, 7, 1 << 20])
def test_tokens(chars):
    text = "A.b É\xa0x\tZÄ,;  y!\x0bq\x85r\n" + "w" * 30 + " end"
    tokens = [t for block in c.token_blocks(text.encode(), chars) for t in block]
    want = []
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        want += [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)] + [b"\xff"]
    assert tokens == want[:-1]
    assert [*c.token_blocks(None)] == [*c.token_blocks(b"")] == []


@pytest.mark.parametrize("shard, block, bits", [(3000, 200, 6), (1 << 22, 1 << 19, 26)])
def test_shards_and_blocks_of_any_size(spark, monkeypatch, shard, block, bits):
    """Six bits are all set: then the bitmap says yes to every phrase."""
    monkeypatch.setattr(c.phrase_counts, "__defaults__", (bits,))
    if bits == 6:
        monkeypatch.setattr(c, "POSITIONS", 100)
        monkeypatch.setattr(c, "ROWS", 50)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(2)
    found = c.collocations(docs, shard=shard, block=block).toPandas()
    want = tables.sql(SMALL, q.COLLOCATIONS_SQL)
    assert len(want) > 30 and difference(found, want) is None


def test_texts_longer_than_a_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_CHARS", 40)
    text = "one two three four five, six seven. " * 60
    df = spark.createDataFrame([(1, text, "en"), (2, text, None), (3, "one two three " * 40, "en")], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = c.collocations(df.coalesce(1), shard=50).toPandas()
    want = tables.sql(str(tmp_path), q.COLLOCATIONS_SQL)
    assert len(want) and difference(found, want) is None


def test_names_are_sparks_hash(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(b"word",), ("É".encode(),), (b"",)], "word binary")
    rows = df.select("word", F.xxhash64(F.lit("s"), F.lit("en"), "word").alias("name")).collect()
    assert [r.name for r in rows] == c.word_names("s", "en", [bytes(r.word) for r in rows]).view(np.int64).tolist()


def test_another_hash_if_two_words_have_one(spark, tmp_path, monkeypatch):
    """With a hash of one bit for the first salt, all words collide; the second salt counts."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b c. " * 40, "en")], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plain, salts = F.xxhash64, []

    def weak(salt, *columns):
        salts.append(salt)
        return F.lit(1).cast("bigint") if len(salts) == 1 else plain(salt, *columns)

    monkeypatch.setattr(c.F, "xxhash64", lambda *cols: weak(*cols) if len(cols) == 3 and cols[1:] == ("lang", "word") else plain(*cols))
    found = c.collocations(df).toPandas()
    assert len(salts) == 2 and difference(found, tables.sql(str(tmp_path), q.COLLOCATIONS_SQL)) is None


def test_products_beyond_64_bits(spark):
    """A cut's product may have over 19 digits, and a quotient just below a whole number stays below."""
    from pyspark.sql import functions as F

    pairs = [(a, b) for a in (9 * 10**17, 10**18 - 1, 30) for b in (9 * 10**17, 10**18, 999_999_999_999_999_989, 60)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "a long, b long, i int")
    rows = df.select("i", c._cut(F.col("a"), F.col("a"), F.col("b"), 1, c.SCALE).alias("cut")).collect()
    assert {r.i: r.cut.score for r in rows} == {i: 2_000_000 * a // (a + b) for i, (a, b) in enumerate(pairs)}
