from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.operators.quantiles import exact_quantiles

PROBABILITIES = [0.25, 0.5, 0.75]


def compare(spark, df):
    got = {
        (r.g, r["column"], r.probability): r.quantile
        for r in exact_quantiles(df, ["g"], ["a", "b"], PROBABILITIES).collect()
    }
    pdf = df.toPandas()
    want = {}
    for g, part in pdf.groupby("g"):
        for c in ("a", "b"):
            values = part[c].dropna().to_numpy()
            for p in PROBABILITIES:
                if len(values):
                    want[g, c, p] = float(np.percentile(values, 100 * p))
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12, abs=1e-12), key


def test_small_groups_are_looked_at_again(spark):
    rows = [("x", float(v), None) for v in (4, 1, 2, 10)] + [("y", 3.0, 1.0), ("y", None, 2.0), ("z", 5.0, None)]
    compare(spark, spark.createDataFrame(rows, "g string, a double, b double"))


def test_large_groups_are_bracketed(spark):
    # One group with most rows; a is spread, b is mostly one value.
    n = 260_000
    df = spark.range(n).select(
        F.when(F.col("id") < n - 5000, "hot").otherwise("cold").alias("g"),
        (F.pow((F.xxhash64("id") % 1_000_003).cast("double") / 1000, F.lit(3)) / 7).alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 5 < 3, 7.0).otherwise((F.xxhash64("id") % 100).cast("double")).alias("b"),
    )
    compare(spark, df)


def test_two_heavy_values_around_a_quantile(spark):
    n = 220_000
    df = spark.range(n).select(
        F.lit("g").alias("g"),
        F.when(F.col("id") < n // 2, 1.0).otherwise(2.0).alias("a"),
        F.when(F.col("id") < n // 4, 1.0).when(F.col("id") < n // 4 + 1, 1.5).otherwise(2.0).alias("b"),
    )
    compare(spark, df)
