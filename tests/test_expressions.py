from __future__ import annotations

import pytest

import numpy as np
from pyspark.sql import functions as F

from stockloom.functions.expressions import (
    at_least_zero,
    exact_mean,
    exact_sum,
    guarded_ratio,
    round_half_even,
    whole_units,
)


def values(spark, column, rows, schema="x double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_rounding_is_the_one_of_numpy(spark):
    numbers = [0.25, 0.35, -0.25, 2.675, 25774.615, 1e9 + 0.05, 0.0]
    for digits in (1, 2):
        got = values(spark, round_half_even("x", digits), [(v,) for v in numbers])
        assert got == [float(np.round(v, digits)) for v in numbers]


def test_ratio_by_zero_is_zero(spark):
    rows = [(6.0, 4.0), (1.0, 0.0), (0.0, 0.0), (1.0, None)]
    assert values(spark, guarded_ratio("n", "d"), rows, "n double, d double") == [1.5, 0.0, 0.0, 0.0]


def test_clipping_and_whole_units(spark):
    rows = [(-2.5,), (0.0,), (3.99,), (None,)]
    assert values(spark, at_least_zero("x"), rows) == [0.0, 0.0, 3.99, None]
    assert values(spark, whole_units("x"), rows) == [0, 0, 3, None]


def test_sums_do_not_depend_on_the_order(spark):
    rows = [(0.1,)] * 10 + [(1e9,), (-1e9,)]
    for ordered in (rows, rows[::-1]):
        df = spark.createDataFrame(ordered, "x double").coalesce(1)
        assert float(df.agg(exact_sum("x")).first()[0]) == 1.0


def test_sum_and_mean_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, None)], "g int, x double")
    got = df.groupBy("g").agg(exact_sum("x").cast("double").alias("s"), exact_mean("x").alias("m")).orderBy("g")
    assert [tuple(r) for r in got.collect()] == [(1, 0.0, None), (2, 3.0, 3.0)]
    assert df.where(F.lit(False)).agg(exact_sum("x")).first()[0] == 0


def test_sums_drop_nothing(spark):
    df = spark.createDataFrame([("a", 1e-7)] * 10 + [("b", 1.4e-6)] * 10 + [("c", 0.1)] * 10, "g string, x double")
    got = {r.g: (r.s, r.m) for r in df.groupBy("g").agg(exact_sum("x").cast("double").alias("s"), exact_mean("x").alias("m")).collect()}
    assert got == {"a": (1e-6, pytest.approx(1e-7)), "b": (1.4e-5, pytest.approx(1.4e-6)), "c": (1.0, 0.1)}


def test_sums_of_very_many_values(spark):
    """What lies below the millionths may add up to over a hundred: the sum of 300 million values,
    made of their residues times their number."""
    value = 0.12345649
    df = spark.createDataFrame([(value,)] * 4, "x double")
    one = df.limit(1).agg(exact_sum("x").alias("s")).first().s
    assert float(one) == value
    from stockloom.functions import expressions as e

    plain = e.residue
    try:
        e.residue = lambda v: plain(v) * 300e6
        total = df.agg(exact_sum("x").alias("s")).first().s
    finally:
        e.residue = plain
    assert float(total) == pytest.approx(4 * (0.123456 + 0.49e-6 * 300e6), abs=1e-6)
