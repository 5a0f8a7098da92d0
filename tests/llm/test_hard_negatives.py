"""Hard negatives: the intervals, and whole results against SQL for other block sizes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from llm import hard_negatives as hard, queries as q

from . import tables


@pytest.mark.parametrize("width", [1, 24, 64, 130])
def test_intervals_hold(width):
    draw = np.random.default_rng(width)
    rows = np.floor(256 * draw.normal(size=(300, width)) * draw.choice((0.01, 1, 100), (300, 1)))
    rows[7] = 0
    turned = hard.rotate(rows)
    assert np.allclose(turned @ turned.T, rows @ rows.T)
    codes = hard.Codes.read(hard.Codes.of(rows).packed(), len(rows))
    for i in (0, 7, 9, 200):
        scores, widths = rows @ rows[i], []

        def needed(kept, lower, upper):
            assert (lower <= scores[kept]).all() and (scores[kept] <= upper).all()
            widths.append((upper - lower).mean())
            return np.ones(len(kept), dtype=bool)

        hard.surviving(hard.Question(turned[i]), codes, np.arange(len(rows)), needed)
        assert len(widths) == hard.PATTERNS and (i == 7 or widths == sorted(widths, reverse=True))


def test_rows_drop_out_before_they_are_scored():
    draw = np.random.default_rng(3)
    rows = np.floor(256 * draw.normal(size=(5000, 64)))
    codes, question = hard.Codes.of(rows), hard.Question(hard.rotate(rows[:1])[0])
    left = hard.surviving(question, codes, np.arange(1, 5000), lambda kept, lower, upper: upper >= hard._greatest(lower, 5))
    assert set(np.argsort(-(rows[1:] @ rows[0]))[:5] + 1) <= set(left.tolist()) and len(left) < 2500


def test_first_takes_ties_in_order():
    assert hard._first(np.array([3, 5, 5, 1, 5, 3]), 4).tolist() == [1, 2, 4, 0]
    assert hard._first(np.array([], dtype=np.int64), 4).tolist() == []


def test_band_is_exact():
    for score in range(-40, 200):
        low, high = hard._band(score, 30, 90)
        assert [n for n in range(-100, 300) if 30 * score <= 100 * n <= 90 * score] == list(range(low, high + 1))


@pytest.mark.parametrize("block, anchor, part", [(1 << 20, 1 << 18, 1 << 25), (2000, 300, 9000)])
def test_hot_vectors_and_small_blocks(spark, tmp_path, block, anchor, part):
    """A third of the rows are one vector, another third one label; blocks of a few rows."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(9, 10))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 9] + 0.4 * draw.normal(size=10)).tolist(), 1 if i % 3 == 1 else i % 10) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard.hard_negatives(df.withColumn("label", relabelled), F.col("id") % 100 == 0, block_bytes=block, anchor_bytes=anchor, part_bytes=part)
    want = tables.sql(str(tmp_path), q.HARD_NEGATIVES_SQL)
    assert len(want) > 100 and difference(found.toPandas(), want) is None


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e9] * 3, 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        hard.hard_negatives(df, F.col("id") % 100 == 0)


def test_clashing_names_and_lengths(spark):
    """Columns with the names used inside; vectors of several lengths, an empty one among them."""
    rows = [(i, [1.0] * (i % 4), i % 2, "x", "y", "z") for i in range(0, 400, 50)]
    df = spark.createDataFrame(rows, "id long, integers array<double>, mark int, label string, part string, block string")
    found = hard.hard_negatives(df, F.col("id") % 100 == 0, key="id", label="mark", vector="integers")
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert all(30 * r.positive_score <= 100 * r.negative_score <= 90 * r.positive_score for r in found.collect())
