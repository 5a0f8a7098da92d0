"""Approximate nearest neighbours by cosine, on shifted Hilbert curves.

Vectors are projected to a few dimensions in several random ways; each projection,
shifted by a random offset, is put in order along a Hilbert curve. Neighbours in space are
often neighbours on at least one of the curves. Spark range-partitions each order and
numbers it; a query looks at the window of places around its own on every curve, the
windows are merged, and candidates are ranked by their exact cosine.

How wide a window must be depends on the data: vectors with structure need a few places,
vectors without any need a share of all. The width is therefore measured: the true
neighbours of a bounded sample of queries are found by comparing these with all
vectors, and the width is the one that reaches ``recall`` of them.

Equal vectors are indexed once, with the smallest k + 1 of their ids: no larger id of
the same vector can be among the k nearest, so nothing is lost, and a vector that a
third of all rows repeat is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.operators.ordered import along_order, in_order
from stockloom.sources.scratch import keep

CURVES, DIMENSIONS, BITS = 8, 8, 6
#: Vectors on a stretch of a curve that one task compares with queries; queries at a time.
TILE, QUERIES = 4096, 256
#: Recall the windows are made for on the sample, and the bounds of the two samples.
RECALL, SAMPLE_QUERIES, SAMPLE_VECTORS = 0.96, 200, 2000
SEED = 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with coordinates below 2**bits, one per row.

    The transform from axes to the transposed index (Skilling 2004), then its bits
    interleaved.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, below = np.int64(1) << level, (np.int64(1) << level) - 1
        for i, axis in enumerate(axes):
            high = (axis & bit) != 0
            swap = np.where(high, 0, (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(high, below, swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] & (np.int64(1) << level)) != 0, (np.int64(1) << level) - 1, 0)
    key = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ flip) >> level) & 1
    return key


def usable(vector: Column) -> Column:
    """Not null, not zero, every component there and finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0.0), F.lit(False)
    )


def _matrix(array: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, each by the same sum wherever the rows stand."""
    return np.einsum("ij,ij->i", a, b) / (
        np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    )


def _best(queries: np.ndarray, names: np.ndarray, rows: np.ndarray, nodes: np.ndarray, k: int):
    """The k nearest rows of each query: names, nodes and exact cosines."""
    scores = _unit(queries) @ _unit(rows).T
    k = min(k, scores.shape[1])
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    # Rows as near as the last one, up to rounding, are kept as well: ties are settled by id.
    last = np.take_along_axis(scores, top, axis=1).min(axis=1)
    at, to = np.nonzero(scores >= last[:, None] - 1e-12)
    return names[at], nodes[to], cosine(queries[at], rows[to])


_PAIRS = "query bigint, node bigint, score double"


def _pairs(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query", "node", "score"])


def distinct_vectors(df: DataFrame, key: str, vector: str, k: int, queried: Column) -> DataFrame:
    """Different vectors: ``node`` (smallest id), ``ids`` (k + 1 smallest), ``asked``, ``vector``.

    Vectors of another length than the most frequent one take no part.
    """
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queried.alias("asked")
    )
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    usual = lengths.first()
    rows = rows.where(F.size("vector") == (usual.n if usual else 0))
    asked = rows.where("asked").select("vector").distinct().withColumn("asked", F.lit(True))
    least = (
        rows.select("id", "vector")
        .withColumn("n", F.dense_rank().over(Window.partitionBy("vector").orderBy("id")))
        .where(F.col("n") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    return keep(
        least.join(asked, "vector", "left").select(
            F.element_at("ids", 1).alias("node"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"), "vector"
        ),
        "vectors",
    )


def _places(vectors: DataFrame, curves: int, dimensions: int, bits: int) -> DataFrame:
    """Place of each node on each curve: curve, node, place."""
    sample = vectors.orderBy(F.xxhash64("node")).limit(SAMPLE_VECTORS).select("vector").collect()
    known = _unit(np.array([r.vector for r in sample])) if sample else np.ones((1, 1))
    draw = np.random.default_rng(SEED)
    width = min(dimensions, known.shape[1])
    axes, low, scale = [], [], []
    for _ in range(curves):
        axis, _ = np.linalg.qr(draw.normal(size=(known.shape[1], known.shape[1])))
        projected = known @ axis[:, :width]
        spread = np.maximum(projected.max(axis=0) - projected.min(axis=0), 1e-12)
        # The box is larger than the sample by a half, and lies differently on each curve.
        axes.append(axis[:, :width])
        low.append(projected.min(axis=0) - spread * draw.uniform(0.05, 0.45, width))
        scale.append((1 << bits) / (1.5 * spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _unit(_matrix(batch.column(1)))
            keys = [
                hilbert(np.clip((rows @ a - lo) * s, 0, (1 << bits) - 1).astype(np.int64), bits) for a, lo, s in zip(axes, low, scale)
            ]
            nodes = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(curves, dtype=np.int32), len(nodes))), pa.array(np.concatenate(keys)), pa.array(np.tile(nodes, curves))],
                names=["curve", "key", "node"],
            )

    keyed = vectors.select("node", "vector").mapInArrow(run, "curve int, key bigint, node bigint")
    ordered = in_order(keyed, ["curve", "key", "node"], "curves")
    placed = along_order(ordered, ["curve"], running={"place": F.lit(1)})
    return keep(placed.select("curve", "node", F.col("place").cast("bigint").alias("place")), "places")


def _true_neighbours(vectors: DataFrame, k: int, sample: int) -> DataFrame:
    """The nearest nodes of a sample of queries, among all: query, node."""
    asked = vectors.where("asked").orderBy(F.xxhash64("node")).limit(sample).select("node", "vector").collect()
    names = np.array([r.node for r in asked], dtype=np.int64)
    queries = np.array([r.vector for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(names):
                yield _pairs(_best(queries, names, _matrix(batch.column(1)), batch.column(0).to_numpy(), k + 1))

    near = vectors.select("node", "vector").mapInArrow(run, _PAIRS)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return near.withColumn("n", F.row_number().over(order)).where((F.col("n") <= k + 1) & (F.col("query") != F.col("node"))).select("query", "node")


def window_width(vectors: DataFrame, places: DataFrame, k: int, recall: float = RECALL, sample: int = SAMPLE_QUERIES) -> int:
    """Places to each side that reach the recall on a sample of queries."""
    pairs = keep(_true_neighbours(vectors, k, sample), "true_neighbours")
    of = lambda name, to: places.select("curve", F.col("node").alias(name), F.col("place").alias(to))
    apart = pairs.join(of("query", "here"), "query").join(of("node", "there"), ["node", "curve"])
    least = apart.groupBy("query", "node").agg(F.min(F.abs(F.col("here") - F.col("there"))).alias("apart"))
    found = least.agg(F.percentile_approx("apart", recall, 100_000).alias("width")).first()
    return int(found.width or 0)


def _search(vectors: DataFrame, places: DataFrame, width: int, k: int, tile: int) -> DataFrame:
    """The nearest candidates of each asked node on each stretch of its windows: query, node, score."""
    placed = places.join(vectors.select("node", "asked", "vector"), "node")
    at = F.floor(F.col("place") / tile)
    stretch = F.sequence(F.greatest(F.floor((F.col("place") - width) / tile), F.lit(0)), F.floor((F.col("place") + width) / tile))
    indexed = placed.select("curve", at.alias("tile"), F.lit(False).alias("is_query"), "node", "vector")
    asking = placed.where("asked").select("curve", F.explode(stretch).alias("tile"), F.lit(True).alias("is_query"), "node", "vector")
    dealt = indexed.unionByName(asking).repartition("curve", "tile").sortWithinPartitions("curve", "tile", "is_query", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, nodes, rows, ready = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, stretch_no, asks, names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            points = _matrix(batch.column(4))
            cuts = np.flatnonzero((np.diff(curve) != 0) | (np.diff(stretch_no) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(curve)]):
                here = (curve[first], stretch_no[first])
                if here != where:
                    where, nodes, rows, ready = here, [], [], None
                if not asks[first]:
                    nodes.append(names[first:last])
                    rows.append(points[first:last])
                    continue
                if not rows:
                    continue  # beyond the end of the curve
                if ready is None:
                    ready = np.concatenate(rows), np.concatenate(nodes)
                for start in range(first, last, QUERIES):
                    stop = min(last, start + QUERIES)
                    yield _pairs(_best(points[start:stop], names[start:stop], *ready, k + 1))

    return dealt.mapInArrow(run, _PAIRS)


def nearest(
    df: DataFrame, queried: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, curves: int = CURVES, tile: int = TILE
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest vectors found for each query.

    Queries are the rows where ``queried`` holds; the candidates are all rows with another
    id. Ties go to the smaller id. Rows with a null id, and vectors that are null, zero, or
    hold a null or a component that is not finite, take no part. Repeated rows count
    once. With fewer than k candidates all are returned.
    """
    vectors = distinct_vectors(df, key, vector, k, queried)
    places = _places(vectors, curves, DIMENSIONS, BITS)
    width = window_width(vectors, places, k)
    found = _search(vectors, places, width, k, tile).groupBy("query", "node").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    by_id = keep(
        found.join(vectors.select("node", "ids"), "node").select(F.col("query").alias("node"), "score", F.explode("ids").alias("id")), "near"
    )
    asked = (
        df.where(queried & F.col(key).isNotNull() & usable(F.col(vector)))
        .select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
        .join(vectors.select("node", "vector"), "vector")
        .select("query_id", "node")
        .distinct()
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (
        asked.join(by_id, "node")
        .where("query_id != id")
        .groupBy("query_id", "id")
        .agg(F.max("score").alias("score"))
        .select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score")
        .where(F.col("rank") <= k)
    )
