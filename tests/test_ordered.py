"""Running values over slices against a plain loop, with one group holding most rows."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from stockloom.operators.ordered import along_order, in_order


@pytest.fixture(scope="module", autouse=True)
def several_slices(spark):
    # These few rows would otherwise be put together into one slice.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def lines(spark):
    hot = F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 13))
    return spark.range(20_000).select(
        hot.alias("group"),
        (F.xxhash64("id") % 100_000).alias("key"),
        "id",
        (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % 11).cast("double").alias("y"),
    )


def test_slices_are_in_order_and_split_a_hot_group(spark, lines):
    ordered = in_order(lines, ["group", "key", "id"], "test")
    pdf = ordered.toPandas().sort_values("line_no")
    expected = pdf.sort_values(["group", "key", "id"])
    assert pdf["line_no"].is_unique
    assert list(pdf["line_no"]) == list(expected["line_no"])
    sizes = pdf.groupby("slice").size()
    assert len(sizes) > 1 and sizes.max() < 0.6 * len(pdf)
    assert pdf[pdf["group"] == "hot"]["slice"].nunique() > 1


def test_running_previous_and_first_match_a_loop(spark, lines):
    ordered = in_order(lines, ["group", "key", "id"], "test")
    result = along_order(
        ordered,
        ["group"],
        running={"total": F.col("x").cast("decimal(28,6)")},
        previous={"before": "y"},
        first={"start": "y"},
    )
    got = result.toPandas().sort_values(["group", "key", "id"]).reset_index(drop=True)
    want = lines.toPandas().sort_values(["group", "key", "id"]).reset_index(drop=True)
    by_group = want.groupby("group")
    assert len(got) == len(want)
    assert list(got["total"].astype(float)) == list(by_group["x"].cumsum())
    pd.testing.assert_series_equal(got["before"], by_group["y"].shift(1), check_names=False)
    assert list(got["start"]) == list(by_group["y"].transform("first"))


def test_same_as_a_plain_window(spark, lines):
    window = Window.partitionBy("group").orderBy("key", "id")
    plain = lines.select("id", F.sum("x").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    ordered = in_order(lines, ["group", "key", "id"], "test")
    sliced = along_order(ordered, ["group"], running={"total": F.col("x").cast("decimal(28,6)")})
    both = plain.join(sliced.select("id", F.col("total").cast("double").alias("ours")), "id")
    assert both.count() == 20_000
    assert both.where("total != ours").isEmpty()


def test_no_rows(spark, lines):
    ordered = in_order(lines.where("id < 0"), ["group", "key", "id"], "test")
    assert along_order(ordered, ["group"], running={"total": F.col("x").cast("decimal(28,6)")}).isEmpty()
