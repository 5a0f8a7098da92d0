"""Token counts from a digest cache: only texts that were never counted are encoded.

A count depends on the text and on the tokenizer alone. The cache is a table of counts
in a folder of its own per tokenizer version, by the digest of the text:

* the content digest is the SHA-256 of the text's UTF-8 bytes, null taken as empty. No
  other normal form is right for all tokenizers: spaces and case are tokens to some.
* the version is a SHA-256 over the vocabulary file, the library with its release, and
  how it is called. A new file or release finds an empty folder.

The digests of all rows are joined to the cache. Of the texts that it lacks, one of each
digest is taken, encoded, and its count appended. Rows of the cache are right one by
one, so a writer that died half-way or two writers at once do no harm: a digest that
was appended twice is read once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.sources.scratch import keep, new_path

from .common import column, in_groups

#: Missing digests (of 32 bytes) up to so many are broadcast to the texts, so that only texts
#: to be encoded are shuffled. Beyond that the texts meet them by a merge join.
FEW = 100_000
#: Tokens beyond which a text is too long for the models in view.
LIMIT = 1024
#: Pieces of up to so many characters, and so many of them, are remembered with their counts by a worker.
SHORT, REMEMBERED = 40, 400_000
_CACHED = "digest binary, n_tokens bigint"


def version(path: str) -> str:
    """Names the tokenizer: vocabulary file, library, release and call."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    call = f"{library.__name__} {library.__version__}: without added special tokens, whole texts\n"
    with open(path, "rb") as file:
        return hashlib.sha256(call.encode() + file.read()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts, by the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    # Spark runs a task on each core: the library's own threads would only compete.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if _cuts_at_spaces(path):
        return _by_pieces(tokenizer)
    return lambda texts: [len(found) for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _cuts_at_spaces(path: str) -> bool:
    """Whether the tokenizer always begins a new piece at a space that follows a visible ASCII
    character: byte-level BPE with its own pattern, and no added token with a space."""
    with open(path, "rb") as file:
        about = json.load(file)
    before, model = about.get("pre_tokenizer") or {}, about.get("model") or {}
    return (
        about.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "unk_token"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in about.get("added_tokens") or [])
    )


def _by_pieces(tokenizer) -> Callable[[list[str]], list[int]]:
    """Texts are cut where the tokenizer cuts them anyway, at a space after a visible ASCII character;
    a short piece that occurs again among the texts at hand is remembered with its count. New short pieces are encoded together,
    a space before each: a piece begins at a token that begins with a space."""
    cut, counts = re.compile(r"(?<=[!-~]) "), {}
    begins = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1, dtype=bool)
    begins[[id for token, id in tokenizer.get_vocab(with_added_tokens=False).items() if token.startswith("\u0120")]] = True

    def learn(pieces: list[str]) -> dict[str, int]:
        # A few hundred at a time: long texts are slow to encode.
        some = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        found = {}
        for own, encoded in zip(some, tokenizer.encode_batch_fast([" " + " ".join(own) for own in some], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype=np.int64)
            starts = np.flatnonzero(begins[ids])
            if len(starts) == len(own):
                found.update(zip(own, np.diff(starts, append=len(ids)).tolist()))
            else:  # a vocabulary with tokens across a piece's space
                found.update((piece, len(e)) for piece, e in zip(own, tokenizer.encode_batch_fast([f" {p}" for p in own], add_special_tokens=False)))
        return found

    def count(texts: list[str]) -> list[int]:
        totals, missed, whole, owners = [], {}, [], []
        if len(counts) > REMEMBERED:
            counts.clear()
        for i, text in enumerate(texts):
            first, *middle = cut.split(text)
            if middle:
                # The last piece may end in anything, and the first has no space before it.
                last = middle.pop()
                whole += [first, " " + last]
                owners += [i, i]
            else:
                whole.append(first)
                owners.append(i)
            known = list(map(counts.get, middle))
            if None in known:
                for piece, n in zip(middle, known):
                    if n is None:
                        if len(piece) <= SHORT and " " not in piece:
                            missed.setdefault(piece, []).append(i)
                        else:
                            whole.append(" " + piece)
                            owners.append(i)
                known = [n for n in known if n is not None]
            totals.append(sum(known))
        for piece, n in learn(list(missed)).items():
            if len(missed[piece]) > 1:
                counts[piece] = n
            for i in missed[piece]:
                totals[i] += n
        for i, found in zip(owners, tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            totals[i] += len(found)
        return totals

    return count


def _encoded(texts: DataFrame, file: str) -> DataFrame:
    """Digest and number of tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(SparkFiles.get(file))
        for batch in batches:
            counts = [n for group in in_groups(column(batch, "text")) for n in count(group)]
            digests = batch.column(batch.schema.get_field_index("digest"))
            yield pa.RecordBatch.from_arrays([digests, pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, _CACHED)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The stored counts of this tokenizer: digest, n_tokens; each digest once."""
    folder = f"{cache}/{version(tokenizer)}"
    if not _exists(spark, folder):
        return spark.createDataFrame([], _CACHED)
    return spark.read.schema(_CACHED).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counted(
    df: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT, few: int = FEW
) -> DataFrame:
    """Key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of each row.

    ``tokenizer`` is a ``.json`` file for tokenizers or a ``.model`` file for sentencepiece, on
    the driver; Spark ships it. ``cache`` is a folder that all executors share; without one,
    the cache lasts for this call only and merely spares repeated texts. Null texts are
    empty: 0 bytes and 0 tokens. Null and repeated keys and repeated rows stay as they are; an
    empty table gives an empty one and leaves the cache alone. Other columns are not read.
    """
    spark = df.sparkSession
    cache = cache or new_path(spark, "token_cache")
    spark.sparkContext.addFile(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(
        F.col(key).alias("key"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), F.octet_length(content).cast("bigint").alias("n_bytes"), content.alias("text")
    )
    rows = keep(texts.drop("text"), "token_rows")
    wanted = rows.select("digest").distinct()
    known = keep(wanted.join(cached(spark, cache, tokenizer), "digest", "left"), "token_known")
    missing = known.where(F.col("n_tokens").isNull()).select("digest")
    n_missing = missing.count()
    if n_missing:
        # Repeated texts come down to one per task before they are shuffled.
        if n_missing <= few:
            once = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        else:
            once = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing.hint("merge"), "digest", "left_semi")
        fresh = keep(_encoded(once, os.path.basename(tokenizer)), "token_fresh")
        fresh.write.mode("append").parquet(f"{cache}/{version(tokenizer)}")
        known = known.where(F.col("n_tokens").isNotNull()).unionByName(fresh)
    # Merged whatever the size: both sides grow with the documents, and a hot digest can be split.
    return rows.join(known.hint("merge"), "digest").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
