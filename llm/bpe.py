"""Byte-level BPE: encoding and decoding by a table of merge ranks.

Each match of the splitting pattern is merged on its own. A segment tree over the
byte positions of a piece holds, in every node, the lowest rank of the pairs that
start below it, and the leftmost of these; its root is the next merge. A merge
changes three leaves (the merged pair, its left and its right neighbour), each
brought up to the root in a logarithmic number of steps. Pieces of similar length
are merged side by side, one tree per row of a numpy array; a long piece has a tree
of its own, so a text without any space costs n log n.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from .common import column, in_groups

#: No pair of neighbours merges.
_NEVER = np.int64(1) << 40
#: Pieces up to so many bytes are merged side by side.
_SIDE_BY_SIDE = 128
#: Cells of all trees that are worked on at a time, and pieces that a task remembers.
_CELLS, _REMEMBERED = 1 << 19, 300_000
#: A text of more characters is split piece by piece, without a list of all pieces.
_LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token, from lines of ``base64 rank``."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Codec:
    """Encodes texts and decodes ids. ``remembered`` bounds the pieces kept for reuse."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = _REMEMBERED):
        self.ranks = ranks
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self._find = regex.compile(pattern)
        self._remembered = remembered
        self._ids: dict[str, str] = {}
        self._byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self._base = max(ranks.values()) + 2
        self._pairs = {
            ranks[token[:cut]] * self._base + ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        keys = np.fromiter(self._pairs.keys(), dtype=np.int64, count=len(self._pairs))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._values = np.fromiter(self._pairs.values(), dtype=np.int64, count=len(keys))[order]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length."""
        if len(text) <= _LONG_TEXT:
            yield self._find.findall(text)
            return
        matches = self._find.finditer(text)
        while part := [m.group() for m in islice(matches, 100_000)]:
            yield part

    def encode_texts(self, texts: list[str]) -> list[Iterator[str]]:
        """For each text its ids, decimal and space-joined, in one or more parts."""
        if len(texts) == 1:
            return [self._parts(self.pieces(texts[0]))]
        split = [next(self.pieces(text)) for text in texts]
        self._learn(set().union(*split))
        ids = self._ids
        return [iter([" ".join([ids[piece] for piece in pieces])]) for pieces in split]

    def _parts(self, lists: Iterable[list[str]]) -> Iterator[str]:
        for pieces in lists:
            self._learn(set(pieces))
            ids = self._ids
            yield " ".join([ids[piece] for piece in pieces])

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.encode_texts([text])[0] for i in part.split()]

    def decode(self, ids: str) -> bytes:
        """The bytes of decimal ids, space-joined. An unknown id is an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""

    def _learn(self, pieces: set[str]) -> None:
        """Make sure that the ids of these pieces are known."""
        new = pieces - self._ids.keys()
        if len(self._ids) + len(new) > self._remembered:
            self._ids = {}
            new = pieces
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self._ids[piece] = str(rank)
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, rows in by_width.items():
            if width > _SIDE_BY_SIDE:
                for piece, raw in rows:
                    self._ids[piece] = " ".join(map(str, self._merge_long(raw, width)))
                continue
            step = max(1, _CELLS // width)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                for (piece, _), ids in zip(part, self._merge_rows([raw for _, raw in part], width)):
                    self._ids[piece] = " ".join(map(str, ids))

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self._base + right
        at = np.searchsorted(self._keys, wanted)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == wanted, self._values[at], _NEVER)

    def _merge_rows(self, raws: list[bytes], width: int) -> list[list[int]]:
        """Merge pieces of at most ``width`` bytes, one tree per row.

        Cell ``width`` of a row stands for "no neighbour". Tree nodes hold
        ``rank * width + position``, so the least is the leftmost of the lowest rank.
        """
        n, bits = len(raws), width.bit_length() - 1
        lengths = np.array([len(raw) for raw in raws])
        padded = np.frombuffer(b"".join(raw.ljust(width, b"\0") for raw in raws), dtype=np.uint8)
        inside = np.arange(width)[None, :] < lengths[:, None]
        token = np.full((n, width + 1), -1, dtype=np.int64)
        token[:, :width] = np.where(inside, self._byte_ids[padded.reshape(n, width)], -1)
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        after[:, :width][after[:, :width] >= lengths[:, None]] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width

        never = _NEVER << bits
        tree = np.full((n, 2 * width), never, dtype=np.int64)
        has_pair = np.arange(width - 1)[None, :] < (lengths - 1)[:, None]
        rows_, cols_ = np.nonzero(has_pair)
        ranks = self._pair_ranks(token[rows_, cols_], token[rows_, cols_ + 1])
        tree[rows_, width + cols_] = np.where(ranks == _NEVER, never, (ranks << bits) + cols_)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        row = np.nonzero(tree[:, 1] < never)[0]
        while row.size:
            best = tree[row, 1]
            at, rank = best & (width - 1), best >> bits
            right = after[row, at]
            following, preceding = after[row, right], before[row, at]
            token[row, at] = rank
            token[row, right] = -1
            after[row, at] = following
            before[row, following] = at
            # The merged pair, the pair before it, and the position that is gone.
            new = self._leaves(rank, token[row, following], at, following, width, bits)
            old = self._leaves(token[row, preceding], rank, preceding, preceding, width, bits)
            changed = np.stack([at, np.where(preceding == width, right, preceding), right]) + width
            tree[row, changed[2]] = never
            tree[row, changed[0]] = new
            known = preceding != width
            tree[row[known], changed[1][known]] = old[known]
            node = changed >> 1
            for _ in range(bits):
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node >>= 1
            row = row[tree[row, 1] < never]
        alive = token[:, :width] >= 0
        flat, counts = token[:, :width][alive].tolist(), alive.sum(axis=1).tolist()
        found, start = [], 0
        for count in counts:
            found.append(flat[start : start + count])
            start += count
        return found

    def _leaves(self, left, right, position, neighbour, width: int, bits: int) -> np.ndarray:
        ranks = self._pair_ranks(left, right)
        none = (ranks == _NEVER) | (neighbour == width)
        return np.where(none, _NEVER << bits, (ranks << bits) + position)

    def _merge_long(self, raw: bytes, width: int) -> list[int]:
        """Merge one long piece; the same tree in plain Python."""
        n, never, base = len(raw), int(_NEVER) * width, self._base
        rank_of = self._pairs.get
        token = [int(self._byte_ids[b]) for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [never] * (2 * width)
        for i in range(n - 1):
            rank = rank_of(token[i] * base + token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(position: int, rank: int | None) -> None:
            node = width + position
            tree[node] = never if rank is None else rank * width + position
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        while tree[1] < never:
            rank, at = divmod(tree[1], width)
            right = after[at]
            following, preceding = after[right], before[at]
            token[at], token[right] = rank, -1
            after[at] = following
            put(right, None)
            if following < n:
                before[following] = at
                put(at, rank_of(rank * base + token[following]))
            else:
                put(at, None)
            if preceding >= 0:
                put(preceding, rank_of(token[preceding] * base + rank))
        return [t for t in token if t >= 0]


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(name: str, pattern: str) -> Codec:
    """One codec for each Python worker, from the file that Spark has shipped."""
    if (name, pattern) not in _codecs:
        _codecs[name, pattern] = Codec(read_ranks(SparkFiles.get(name)), pattern)
    return _codecs[name, pattern]


def _shipped(df: DataFrame, path: str) -> str:
    """Ship the rank file to the executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column, an array of int. A null text is empty."""
    name = _shipped(df, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts):
        import pandas as pd

        codec = _codec(name, pattern)
        found = [
            np.array([i for part in parts for i in part.split()], dtype=np.int32)
            for group in in_groups(texts)
            for parts in codec.encode_texts(group)
        ]
        return pd.Series(found, dtype=object)

    return df.withColumn(ids, ids_of(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes of an array of ids. Null ids are none; an unknown id is an error."""
    name = _shipped(df, path)

    @F.pandas_udf(T.BinaryType())
    def bytes_of(arrays):
        codec = _codec(name, pattern)
        return arrays.map(lambda a: codec.decode(" ".join(map(str, a))) if a is not None else b"")

    return df.withColumn(decoded, bytes_of(F.col(ids)))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text, and keep the number of ids and two digests.

    One row per input row: the key, ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by spaces) and ``decoded_sha256`` (of the bytes the ids decode to). A null
    text is empty and has no ids; repeated rows are repeated. The ids do not leave
    the task. Other columns of the input are not read.
    """
    name = _shipped(df, path)
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for group in in_groups(column(batch, text)):
                for parts in codec.encode_texts(group):
                    n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                    for part in parts:
                        if part:
                            ids_hash.update((f" {part}" if n else part).encode())
                            bytes_hash.update(codec.decode(part))
                            n += part.count(" ") + 1
                    counts.append(n)
                    of_ids.append(ids_hash.hexdigest())
                    of_bytes.append(bytes_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(run, schema)
