"""Token counts: the library's own, whatever the cache holds."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import token_counts

from . import tables

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_TEXTS = ["a b", "a  b", "<|endoftext|> in a text", "É x \U0001f600", "", "<s> </s>", "  ", "x" * 5000]


@pytest.fixture()
def docs(spark):
    extra = spark.createDataFrame([(100 + i, t, "en", "a", 1, *"xyz0") for i, t in enumerate(_TEXTS)], tables.documents(spark).schema)
    return tables.documents(spark).unionByName(extra).withColumn("digest", F.lit("clash")).withColumn("n_tokens", F.lit(-1))


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("file", [JSON, MODEL])
def test_counts_are_the_librarys(docs, file, few):
    if file == JSON:
        plain = lambda t: len(Tokenizer.from_file(JSON).encode(t, add_special_tokens=False).ids)
    else:
        plain = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(t))
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := plain(r.text or ""), n > 1024) for r in docs.collect())
    rows = token_counts.counted(docs, file, few=few)
    assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect()) == want


def test_only_misses_are_encoded(spark, docs, tmp_path, monkeypatch):
    cache, encoded = str(tmp_path / "cache"), []
    plain = token_counts._encoded

    def seen(texts, file):
        encoded.append(sorted(r.text for r in texts.collect()))
        return plain(texts, file)

    monkeypatch.setattr(token_counts, "_encoded", seen)
    some = docs.where("doc_id < 9")
    token_counts.counted(some, JSON, cache).collect()
    first = token_counts.counted(docs, JSON, cache).collect()
    again = token_counts.counted(docs, JSON, cache).collect()
    # Each text once, the second time only the new ones, and then none.
    everything = {r.text or "" for r in docs.collect()}
    early = {r.text or "" for r in some.collect()}
    assert encoded == [sorted(early), sorted(everything - early)]
    assert sorted(map(str, again)) == sorted(map(str, first))
    assert token_counts.cached(spark, cache, JSON).count() == len(everything)


def test_the_cache_is_the_tokenizers_own(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    token_counts.counted(docs, JSON, cache).collect()
    assert token_counts.version(JSON) != token_counts.version(MODEL)
    assert token_counts.cached(spark, cache, MODEL).isEmpty()


def test_half_written_and_doubled_rows_do_no_harm(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    first = sorted(map(str, token_counts.counted(docs, JSON, cache).collect()))
    folder = f"{cache}/{token_counts.version(JSON)}"
    stored = spark.read.parquet(folder).cache()
    stored.write.mode("append").parquet(folder)
    stored.limit(2).write.parquet(f"{folder}/_temporary/0")
    assert sorted(map(str, token_counts.counted(docs, JSON, cache).collect())) == first


def test_empty_table_leaves_the_cache_alone(docs, tmp_path):
    assert token_counts.counted(docs.limit(0), JSON, str(tmp_path / "cache")).collect() == []
    assert not (tmp_path / "cache").exists()
