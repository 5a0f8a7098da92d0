"""Hard negatives by rotated one-bit codes and integer scores.

Vectors are turned into integers, and scores are integer inner products. Each vector v
is also stored as codes: it is rotated (random signs and Hadamard transforms), and its
rotated form r is written as a sum of sign patterns,

    r = a1 u1 + a2 u2 + ... + e,     u = signs / sqrt(D),   a = <u, what was left>,

each pattern one bit per dimension with its alignment a stored beside it, and the
length of what is left after each of them. For a query q, rotated likewise and rounded
to eight bits per dimension,

    <v, q> = a1 <u1, q> + a2 <u2, q> + ... + <e, q>,

where the inner products with patterns are popcounts of the code and the query's bit
planes, and |<e, q>| is at most |e| |q - <u, q> u| (Cauchy-Schwarz; e is orthogonal to the
last pattern u), plus what rounding the query may do. So each row has an interval that
its score surely lies in. A row goes on to the next pattern only while its interval may
still matter, and what is left in the end is scored with the integers themselves.
Nothing is lost: the intervals are bounds, not guesses.

How it is dealt out. Rows are packed into blocks of bounded size, written, and dealt to
parts. Anchors are packed likewise, and each block of anchors goes to every part: a part holds
its rows and reads the anchors one block after the other. What a part finds for an anchor
is merged by a window of a few rows per part. First the positives are found, then, with
their scores as bands, the negatives. Work grows with anchors times rows, by the task;
memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.sources.scratch import keep

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Sign patterns per vector, bits of a query's rounding, seed of the rotation.
PATTERNS, PLANES, SEED = 4, 8, 42
#: Bytes of integer components in a block of rows, in a block of anchors, and in a part.
BLOCK_BYTES, ANCHOR_BYTES, PART_BYTES = 1 << 20, 1 << 18, 1 << 25

_BLOCK = "ids array<bigint>, labels array<bigint>, marks array<bigint>, integers binary, codes binary"


# Rotation and codes.


def padded(width: int) -> int:
    """Dimensions of the codes: a power of two, whole words."""
    return max(64, 1 << max(0, width - 1).bit_length())


def rotate(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows (zero-padded to a power of two) under a fixed random rotation."""
    size = padded(rows.shape[1])
    turned = np.zeros((len(rows), size))
    turned[:, : rows.shape[1]] = rows
    draw = np.random.default_rng(seed)
    for _ in range(3):
        turned *= draw.choice((-1.0, 1.0), size)
        half = 1
        while half < size:
            pairs = turned.reshape(len(rows), -1, 2, half)
            turned = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), size)
            half *= 2
        turned /= np.sqrt(size)
    return turned


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


@dataclass
class Codes:
    """The codes of some rows; the first axis of ``signs`` and ``align`` is the pattern."""

    signs: np.ndarray
    align: np.ndarray
    #: Length of the sum of patterns so far, and of what is left after each.
    length: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, patterns: int = PATTERNS) -> Codes:
        rest = rotate(rows)
        size = rest.shape[1]
        sum_so_far = np.zeros_like(rest)
        signs, align, length, left = [], [], [], []
        for _ in range(patterns):
            up = rest > 0
            step = np.abs(rest).mean(axis=1)[:, None]
            pattern = np.where(up, step, -step)
            rest = rest - pattern
            sum_so_far += pattern
            signs.append(_words(up))
            align.append(step[:, 0] * np.sqrt(size))
            length.append(np.sqrt(np.einsum("ij,ij->i", sum_so_far, sum_so_far)))
            left.append(np.sqrt(np.einsum("ij,ij->i", rest, rest)))
        return cls(*map(np.array, (signs, align, length, left)))

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (self.align, self.length, self.left, self.signs))

    @classmethod
    def read(cls, packed: bytes, n: int) -> Codes:
        words = np.frombuffer(packed, dtype=np.uint64)
        numbers = words[: 3 * PATTERNS * n].view(np.float64).reshape(3, PATTERNS, n)
        return cls(words[3 * PATTERNS * n :].reshape(PATTERNS, n, -1), *numbers)


class Question:
    """A query's rotated form in bit planes, and the intervals of the scores of coded rows."""

    def __init__(self, turned: np.ndarray, planes: int = PLANES):
        size = len(turned)
        self.low = turned.min()
        self.step = max((turned.max() - self.low) / ((1 << planes) - 1), 1e-300)
        rounded = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.planes = [_words((rounded >> p & 1).astype(bool)) for p in range(planes)]
        known = self.low + self.step * rounded
        self.total, self.root = known.sum(), np.sqrt(size)
        self.norm = np.sqrt(turned @ turned)
        self.error = np.sqrt(((turned - known) ** 2).sum())

    def along(self, signs: np.ndarray) -> np.ndarray:
        """<u, q> for the rows' sign patterns, by popcounts."""
        above = np.zeros(len(signs), dtype=np.int64)
        for p, plane in enumerate(self.planes):
            above += np.bitwise_count(signs & plane).sum(axis=1, dtype=np.int64) << p
        up = self.low * np.bitwise_count(signs).sum(axis=1, dtype=np.int64) + self.step * above
        return (2 * up - self.total) / self.root


def surviving(question: Question, codes: Codes, rows: np.ndarray, needed) -> np.ndarray:
    """The rows whose scores may matter.

    ``needed(rows, lower, upper)`` tells which rows to go on with, by bounds of their scores.
    """
    estimate = np.zeros(len(rows))
    for k in range(len(codes.signs)):
        if not len(rows):
            break
        along = question.along(codes.signs[k][rows])
        estimate += codes.align[k][rows] * along
        # The query's part that is orthogonal to this pattern; its known part may be off by the rounding.
        across = np.sqrt(np.maximum(question.norm**2 - np.maximum(np.abs(along) - question.error, 0) ** 2, 0))
        # The last term is for the rounding of these sums themselves.
        reach = codes.left[k][rows] * across + codes.length[k][rows] * question.error
        reach += 1e-9 * (codes.length[k][rows] + codes.left[k][rows]) * question.norm + 1e-6
        go_on = needed(rows, estimate - reach, estimate + reach)
        rows, estimate = rows[go_on], estimate[go_on]
    return rows


def _greatest(values: np.ndarray, k: int) -> float:
    """The k-th greatest value, or -infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the first ones. Ties may be any number."""
    if len(scores) > k:
        least = _greatest(scores, k)
        above = np.flatnonzero(scores > least)
        places = np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, -scores[places]))]


# Blocks.


def _integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))


def _taking_part(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.coalesce(~F.exists(F.col(vector), odd), F.lit(False))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & whole)
    return rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), _integers(F.col(vector)).alias("integers"))


def _packed(rows: DataFrame, width: int, block_bytes: int, coded: bool, name: str) -> DataFrame:
    """Rows in blocks ordered by id, an equal row once per block, with their codes if these
    are wanted. Shorter vectors end in zeros."""
    most = max(1, block_bytes // (8 * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids, labels, marks, integers = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((marks, labels, ids))
            ids, labels, marks = ids[order], labels[order], marks[order]
            new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (marks[1:] != marks[:-1])))
            integers = np.ascontiguousarray(integers[order][new])
            codes = Codes.of(integers.astype(np.float64)).packed() if coded else None
            values = [[ids[new].tolist()], [labels[new].tolist()], [marks[new].tolist()], [integers.tobytes()], [codes]]
            kinds = [pa.list_(pa.int64())] * 3 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if size and size + part.num_rows > most:
                    yield block()
                    held, size = [], 0
                lists = part.column(3)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                integers = np.zeros((part.num_rows, width), dtype=np.int64)
                integers[np.arange(width)[None, :] < lengths[:, None]] = flat
                held.append((*[part.column(i).to_numpy() for i in range(3)], integers))
                size += part.num_rows
        if size:
            yield block()

    marked = rows.select("id", "label", F.xxhash64("label", "integers").alias("mark"), "integers")
    return keep(marked.mapInArrow(run, _BLOCK), name)


@dataclass
class _Block:
    ids: np.ndarray
    labels: np.ndarray
    marks: np.ndarray
    integers: np.ndarray

    @classmethod
    def read(cls, row: dict) -> _Block:
        ids, labels, marks = (np.array(row[c], dtype=np.int64) for c in ("ids", "labels", "marks"))
        return cls(ids, labels, marks, np.frombuffer(row["integers"], dtype=np.int64).reshape(len(ids), -1))

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products; every sum fits in 64 bits (see ``hard_negatives``)."""
        return self.integers[rows] @ anchor


_FOUND = "anchor bigint, mark bigint, label bigint, score bigint, positive bigint, positive_mark bigint, positive_score bigint, id bigint, id_mark bigint"


def _dealt(blocks: DataFrame, anchors: DataFrame, parts: int, find) -> DataFrame:
    """``find(blocks, codes, anchors)`` for each part of the row blocks and each block of anchors."""
    part = F.pmod(F.hash("ids", "marks"), F.lit(parts)).alias("part")
    rows = blocks.select(part, F.lit(False).alias("asks"), F.struct(*blocks.columns).alias("block"), F.lit(None).cast(_BANDS).alias("bands"))
    bands = "bands" if "bands" in anchors.columns else F.lit(None).cast(_BANDS).alias("bands")
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), F.struct(*blocks.columns).alias("block"), bands
    )
    # With a number of their own these partitions stay as they are, however few bytes they hold.
    dealt = rows.unionByName(asking).repartition(parts, "part").sortWithinPartitions("part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] != here:
                    here, held = row["part"], []
                block = _Block.read(row["block"])
                if not row["asks"]:
                    held.append((block, Codes.read(row["block"]["codes"], len(block.ids))))
                    continue
                if held:
                    out = [np.concatenate(x) for x in zip(*find(held, block, row["bands"]))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[f.split()[0] for f in _FOUND.split(", ")])

    return dealt.mapInArrow(run, _FOUND)


_BANDS = "array<struct<anchor:bigint,mark:bigint,label:bigint,id:bigint,id_mark:bigint,score:bigint>>"


def _questions(anchors: _Block) -> list[Question]:
    return [Question(turned) for turned in rotate(anchors.integers.astype(np.float64))]


def _filled(n: int, value) -> np.ndarray:
    return np.full(n, value, dtype=np.int64)


def _positives_of(k: int):
    """The first k other rows of the anchor's label, in each part."""

    def find(held, anchors: _Block, _bands):
        for a, question in enumerate(_questions(anchors)):
            best: list[tuple] = []
            least = -np.inf
            for block, codes in held:

                def needed(rows, lower, upper):
                    return upper >= max(least, _greatest(lower, k))

                rows = np.flatnonzero((block.labels == anchors.labels[a]) & (block.ids != anchors.ids[a]))
                rows = surviving(question, codes, rows, needed)
                scores = block.scores(rows, anchors.integers[a])
                top = _first(scores, k)
                best.append((scores[top], block.ids[rows[top]], block.marks[rows[top]]))
                least = max(least, _greatest(np.concatenate([b[0] for b in best]).astype(np.float64), k))
            scores, ids, marks = (np.concatenate(x) for x in zip(*best))
            n = len(ids)
            none = _filled(n, 0)
            yield _filled(n, anchors.ids[a]), _filled(n, anchors.marks[a]), _filled(n, anchors.labels[a]), scores, none, none, none, ids, marks

    return find


def _band(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole scores n with least * score <= 100 * n <= most * score."""
    return -(-least * score // 100), most * score // 100


def _negatives_of(k: int, least_share: int, most_share: int):
    """The first k rows of another label inside each positive's band, in each part."""

    def find(held, anchors: _Block, bands):
        by_anchor: dict[tuple, list] = {}
        for b in bands or []:
            low, high = _band(b["score"], least_share, most_share)
            if low <= high:
                by_anchor.setdefault((b["anchor"], b["mark"], b["label"]), []).append((low, high, b))
        for a, question in enumerate(_questions(anchors)):
            wanted = by_anchor.get((anchors.ids[a], anchors.marks[a], anchors.labels[a]), [])
            if not wanted:
                continue
            least = [-np.inf] * len(wanted)
            found: list[list] = [[] for _ in wanted]
            for block, codes in held:

                def needed(rows, lower, upper):
                    wide = np.zeros(len(rows), dtype=bool)
                    for w, (low, high, _) in enumerate(wanted):
                        inside = (lower >= low) & (upper <= high)
                        enough = max(least[w], _greatest(lower[inside], k))
                        wide |= (upper >= max(low, enough)) & (lower <= high)
                    return wide

                rows = surviving(question, codes, np.flatnonzero(block.labels != anchors.labels[a]), needed)
                scores = block.scores(rows, anchors.integers[a])
                for w, (low, high, _) in enumerate(wanted):
                    within = np.flatnonzero((scores >= low) & (scores <= high))
                    top = within[_first(scores[within], k)]
                    found[w].append((scores[top], block.ids[rows[top]], block.marks[rows[top]]))
                    least[w] = max(least[w], _greatest(np.concatenate([f[0] for f in found[w]]).astype(np.float64), k))
            for (_, _, b), parts in zip(wanted, found):
                scores, ids, marks = (np.concatenate(x) for x in zip(*parts))
                n = len(ids)
                own = (anchors.ids[a], anchors.marks[a], anchors.labels[a])
                yield *[_filled(n, x) for x in own], scores, *[_filled(n, b[c]) for c in ("id", "id_mark", "score")], ids, marks

    return find


def _ranked(found: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first k different rows of each group, numbered from 1."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id", "id_mark")
    # Equal rows of different blocks share a rank here, and become one row below.
    first = found.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k)
    return first.groupBy(*group, "n", "score", "id", "id_mark").agg(F.lit(1).alias("one")).drop("one")


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    block_bytes: int = BLOCK_BYTES,
    anchor_bytes: int = ANCHOR_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows where ``anchor``, a condition on ``id`` (the key as a bigint), holds.
    Components count as floor(256 x). Rows with a null key, label or vector, or with a
    component that is null or not finite, take no part. Vectors may be empty or zero
    (scores of 0); shorter ones count as if they ended in zeros. Rows that are equal in key,
    label and components count once; rows that share a key otherwise are rows of their own, and
    none is its own key's positive. Ties go to the smaller key, then to a hash of the
    components. Anchors without positives, and positives without negatives, have no row. An
    empty table gives an empty one. Raises an error if a score might not fit in 64 bits.
    """
    rows = keep(_taking_part(df, key, label, vector), "hard_rows")
    biggest = F.max(F.greatest(F.abs(F.array_max("integers")), F.abs(F.array_min("integers"))))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("integers")).alias("width"), biggest.alias("most")).first()
    width = shape.width or 0
    if width * (shape.most or 0) ** 2 >= 1 << 62:
        raise ValueError(f"products of components up to {shape.most} in {width} dimensions do not fit in 64 bits")
    blocks = _packed(rows, width, block_bytes, True, "hard_blocks")
    anchors = _packed(rows.where(anchor), width, anchor_bytes, False, "hard_anchors")
    parts = max(-(-shape.n * width * 8 // part_bytes), min(blocks.count(), 2 * df.sparkSession.sparkContext.defaultParallelism), 1)

    group = ["anchor", "mark", "label"]
    near = keep(_ranked(_dealt(blocks, anchors, parts, _positives_of(positives)), group, positives), "hard_positives")
    # Each block of anchors takes its anchors' positives along: a few for each.
    numbered = keep(anchors.withColumn("block", F.monotonically_increasing_id()), "hard_numbered")
    names = numbered.select("block", F.explode(F.arrays_zip("ids", "marks", "labels")).alias("own"))
    names = names.select("block", F.col("own.ids").alias("anchor"), F.col("own.marks").alias("mark"), F.col("own.labels").alias("label"))
    bands = names.join(near, group).groupBy("block").agg(
        F.collect_list(F.struct("anchor", "mark", "label", "id", "id_mark", "score")).alias("bands")
    )
    asking = numbered.join(bands, "block").drop("block")
    found = _dealt(blocks, asking, parts, _negatives_of(negatives, least, most))
    return _ranked(found, [*group, "positive", "positive_mark", "positive_score"], negatives).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("n").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

