"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits, each the majority of that bit over the hashes of all word
shingles. Fingerprints at most ``radius`` bits apart are linked, and documents are
grouped by the links.

Where to compare. The 64 bits are cut into ``radius + 2`` parts. Two linked
fingerprints agree in at least two parts, so all links are found among fingerprints
that agree in some pair of parts: ten buckets per fingerprint for a radius of three,
each fixing about 25 bits. A bucket of more than ``BUCKET`` fingerprints is not
compared but dealt out again by the same rule on the bits that are still free. Each
such step fixes more bits, and with twelve free bits left no bucket can hold more
than 4096 different fingerprints: the steps end, and no pair is left out.

How to compare. The fingerprints of a bucket are stored as bit planes: plane b holds
bit b of all of them, 64 to a machine word. Distances are counted for 64 pairs at a
time by carry-save addition of the differing planes into bit-wise counters; a pair
whose counter overflows is out, and a block whose pairs are all out is abandoned
before the remaining planes.

A task passes on one link per fingerprint and bucket, to the smallest fingerprint it
reaches inside the bucket, so the links grow with the rows and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from stockloom.sources.scratch import keep

from .common import column, word_blocks

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Most fingerprints of a bucket that are compared in one task; at least 4096.
BUCKET = 4096
#: Buckets of up to so many are compared by shifting the planes of a whole chunk.
_SMALL = 64
#: Planes between two looks at which blocks are still of interest; queries at a time.
_PLANES, _QUERIES = 8, 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as an unsigned number; without words it is 0.

    Shingles count as often as they occur. A text of fewer words than a shingle has
    one, all its words.
    """
    counts, total = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    blocks = word_blocks(text, carry=shingle - 1, fold=True)
    block: list[bytes] | None = next(blocks)
    while block is not None:
        following = next(blocks, None)
        if following is None and 0 < len(block) < shingle and total == 0:
            # The last block holds every word there is: fewer than a shingle are carried on.
            runs = [b" ".join(block)]
        else:
            runs = map(b" ".join, zip(*[block[i:] for i in range(shingle)]))
        hashes = np.array([digest(run, SEED) for run in runs], dtype=np.uint64)
        for start in range(0, len(hashes), 1 << 14):
            part = hashes[start : start + (1 << 14)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
        block = following
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint (a signed bigint with the same 64 bits) of each row."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t) for t in column(batch, text)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return df.select(key, text).mapInArrow(run, schema)


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """The bits fixed by each pair of parts of the bits that ``mask`` leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(free, radius + 2)]
    return [mask | a | b for a, b in combinations(parts, 2)]


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _dealt(mask: int, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask, fixed bits and fingerprint, for each fingerprint and finer mask."""
    masks = _signed(finer_masks(mask & 0xFFFFFFFFFFFFFFFF, radius))
    return (
        np.repeat(masks, len(fps)),
        (fps[None, :] & masks[:, None]).ravel(),
        np.tile(fps, len(masks)),
    )


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word, zero-padded."""
    padded = np.zeros(-len(fps) % 64 + len(fps), dtype=np.uint64)
    padded[: len(fps)] = fps.view(np.uint64)
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _words_of(flags: np.ndarray) -> np.ndarray:
    """Flags (last axis a multiple of 64) as words."""
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


def within(
    differing: Callable[[int, np.ndarray], np.ndarray], out: np.ndarray, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Blocks with pairs inside the radius: their numbers, and words with those bits set.

    ``differing(b, blocks)`` gives, for the blocks still of interest, words that have a
    bit set for each pair that differs in bit b. ``out`` has the pairs set that do not
    count from the start; one row of words per block.
    """
    blocks = np.flatnonzero((out != _ALL).any(axis=1))
    out = out[blocks]
    # Counters start so that they overflow on the first difference beyond the radius.
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    counters = [np.full_like(out, _ALL if start >> i & 1 else 0) for i in range(width)]
    for first in range(0, 64, _PLANES):
        if not blocks.size:
            break
        for b in range(first, first + _PLANES):
            carry = differing(b, blocks)
            for i, counter in enumerate(counters):
                counters[i], carry = counter ^ carry, counter & carry
            out |= carry
        alive = (out != _ALL).any(axis=1)
        if not alive.all():
            blocks, out = blocks[alive], out[alive]
            counters = [counter[alive] for counter in counters]
    return blocks, ~out


def _pairs_set(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit number of all bits set."""
    return np.nonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little"))


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the same root, the smallest row."""
    while a.size:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        if not a.size:
            return
        np.minimum.at(root, high, low)
        while (nearer := root[root]).tobytes() != root.tobytes():
            root[:] = nearer


def roots_in_buckets(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row that links reach inside its bucket.

    ``bucket`` numbers ascend along the rows. Small buckets are compared together:
    shifting all planes by s compares each row with the s-th after it. The others are
    compared one by one, each fingerprint with the planes of its bucket.
    """
    n = len(fps)
    root = np.arange(n)
    if n < 2:
        return root
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, n))
    size_of = np.repeat(sizes, sizes)

    planes = np.pad(planes_of(fps), ((0, 0), (0, 1)))
    small = size_of <= _SMALL
    for shift in range(1, min(_SMALL, int(sizes[sizes <= _SMALL].max(initial=1)))):
        same = np.zeros((planes.shape[1] - 1) * 64, dtype=bool)
        same[: n - shift] = (bucket[shift:] == bucket[:-shift]) & small[shift:]
        if not same.any():
            break
        out = ~_words_of(same)[:, None]
        up, down = np.uint64(shift), np.uint64(64 - shift)

        def differing(b: int, blocks: np.ndarray) -> np.ndarray:
            here = planes[b][blocks]
            return (here ^ (here >> up | planes[b][blocks + 1] << down))[:, None]

        blocks, words = within(differing, out, radius)
        rows, bits = _pairs_set(words)
        at = blocks[rows] * 64 + bits
        _unite(root, at, at + shift)

    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        own = fps[start : start + size].view(np.uint64)
        own_planes = planes_of(own)
        column_of = np.arange(own_planes.shape[1] * 64)
        for first in range(0, size, _QUERIES):
            queries = own[first : first + _QUERIES]
            number = np.arange(first, first + len(queries))
            out = _words_of((column_of[None, :] <= number[:, None]) | (column_of >= size)[None, :])

            def differing(b: int, blocks: np.ndarray) -> np.ndarray:
                bit = (queries[blocks] >> np.uint64(b)) & np.uint64(1)
                return own_planes[b][None, :] ^ (bit * _ALL)[:, None]

            blocks, words = within(differing, out, radius)
            rows, bits = _pairs_set(words)
            _unite(root, start + number[blocks[rows]], start + bits)
    return root


_DEALT = "mask bigint, part bigint, fp bigint"
_FOUND = "again boolean, mask bigint, part bigint, fp bigint"


def _deal(fps: DataFrame, radius: int) -> DataFrame:
    """The buckets of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _dealt(0, batch.column(0).to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mask", "part", "fp"])

    return fps.select("fp").mapInArrow(run, _DEALT)


def _compare(dealt: DataFrame, radius: int, most: int) -> DataFrame:
    """Links found in the buckets (mask null; part is the smaller end), or finer buckets."""

    def links(mask: np.ndarray, part: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
        root = roots_in_buckets(np.cumsum(new), fps, radius)
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return table_of(False, None, fps[root[linked]], fps[linked])

    def table_of(again: bool, mask, part, fps) -> pa.RecordBatch:
        n = len(fps)
        masks = pa.nulls(n, pa.int64()) if mask is None else pa.array(mask)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, again)), masks, pa.array(part), pa.array(fps)], names=["again", "mask", "part", "fp"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64)] * 3
        large = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if large is not None:
                more = (rows[0] == large[0]) & (rows[1] == large[1])
                if more.any():
                    yield table_of(True, *_dealt(large[0], rows[2][more], radius))
                    rows = [r[~more] for r in rows]
                if not rows[0].size:
                    continue
                large = None
            held = [np.concatenate(pair) for pair in zip(held, rows)]
            mask, part, fps = held
            last = int(np.flatnonzero((mask != mask[-1]) | (part != part[-1])).max(initial=-1)) + 1
            if last:
                yield links(mask[:last], part[:last], fps[:last])
            held = [h[last:] for h in held]
            if len(held[0]) > most:
                large = (int(held[0][0]), int(held[1][0]))
                yield table_of(True, *_dealt(large[0], held[2], radius))
                held = [h[:0] for h in held]
        if held[0].size:
            yield links(*held)

    return dealt.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(run, _FOUND)


def links_of(fps: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """Links (high, low) that connect all different fingerprints inside the radius."""
    if most < 1 << 12:
        raise ValueError("buckets of fewer than 4096 fingerprints might never be small enough")
    dealt, found = _deal(fps, radius), None
    while True:
        step = keep(_compare(dealt, radius, most), "simhash_links")
        links = step.where(~F.col("again")).select(F.col("fp").alias("high"), F.col("part").alias("low"))
        found = links if found is None else found.unionByName(links)
        dealt = step.where("again").select("mask", "part", "fp")
        if dealt.isEmpty():
            return found.distinct()


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """Node and root (the smallest node reached) of all linked nodes.

    Links (high, low), high > low. Each round hands the neighbours of a node to the
    smallest of them, first the larger neighbours and then the smaller ones, until every
    node hangs on its root; rounds grow with the logarithm of the longest chain. Each
    round is a written table. Only a count and a sum of hashes come to the driver.
    """
    links, before = keep(links, name), None
    while True:
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("least")).select(F.col("high").alias("low"), F.least("high", "least").alias("to"))
        links = keep(links.join(least, "low").select("high", F.col("to").alias("low")).distinct(), name)
        least = links.groupBy("high").agg(F.min("low").alias("to"))
        pairs = links.join(least, "high").select(
            F.explode(F.array(F.struct("high", F.col("to").alias("low")), F.struct(F.col("low").alias("high"), F.col("to").alias("low")))).alias("link")
        )
        links = keep(pairs.select("link.high", "link.low").where("high != low").distinct(), name)
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")), F.lit(0)).alias("sum")
        ).first()
        if state == before:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
        before = state


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Key, ``fingerprint`` (16 hex digits) and ``component_id`` of each row.

    ``component_id`` is the smallest key that links reach, the row's own included; null
    if all keys of the group are null. Null and empty texts have the fingerprint 0 and are
    linked like any other. Repeated rows are repeated. Other columns are not read.
    """
    fps = keep(fingerprints(df, key, text), "simhash")
    nodes = keep(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash_nodes")
    roots = connected(links_of(nodes, radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = keep(rooted.join(groups, "root").select("fp", "component_id"), "simhash_groups")
    return fps.join(by_fp, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
