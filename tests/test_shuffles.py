"""How often the lines are moved: once to be put in order, once for the windows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.star import raw_tables, star_tables
from stockloom import demand_features, running_stock, sales_fact
from stockloom.operators import aggregates
from stockloom.plans import forecasting
from stockloom.sources import scratch

from .tables import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sales(spark, n: int):
    """Lines of few groups, each cell twice, with both zeros, missing keys and rows that repeat."""
    pick = lambda *values: F.array(*[F.lit(v) for v in values])[(F.xxhash64("id", F.lit(str(values))) % len(values) + len(values)).cast("int") % len(values)]
    return spark.range(n).select(
        (F.col("id") % 5 + 1).alias("SIM_ROUND"),
        pick("A", "A", "A", "B").alias("SALES_ORGANIZATION"),
        pick("p", "p", "q", None).alias("MATERIAL_CODE"),
        pick("x", "y").alias("DISTRIBUTION_CHANNEL"),
        pick("N", "S").alias("AREA"),
        pick(0.0, -0.0, 2.5).alias("NET_PRICE"),
        (F.col("id") % 40).cast("double").alias("NET_VALUE"),
        pick(1.5, 2.5).alias("COST"),
        (F.col("id") % 3).cast("double").alias("QUANTITY_DELIVERED"),
        pick(0.0, -0.0).alias("CONTRIBUTION_MARGIN"),
        pick("name", "other").alias("MATERIAL_DESCRIPTION"),
        (F.col("id") % 4).cast("double").alias("QUANTITY"),
    )


@pytest.mark.parametrize("drop", ["none", "QUANTITY", "QUANTITY_DELIVERED"])
def test_ordered_fact_gives_the_same_lines(spark, drop):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        given = tables(spark, sales=_sales(spark, 4000).drop(drop))
        for step in (demand_features, running_stock):
            want = step(sales_fact(given))
            got = step(sales_fact(given, ordered=True))
            assert got.columns == want.columns
            rows = lambda df: sorted(map(str, df.drop("line_no").collect()))
            assert rows(got) == rows(want) and rows(got)
        fact = sales_fact(given, ordered=True)
        numbered = fact.select("line_no", *aggregates.line_order(fact)).collect()
        assert [r[1:] for r in sorted(numbered)] == sorted(r[1:] for r in numbered)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_are_moved_once_to_be_ordered(spark):
    lines = aggregates.sales_lines(tables(spark, sales=_sales(spark, 4000)).sales, ranged=True)
    plan = _plan(lines.sort(*aggregates.line_order(lines)))
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan


def test_no_lines(spark):
    given = tables(spark, sales=_sales(spark, 0))
    assert demand_features(sales_fact(given, ordered=True)).isEmpty()


def test_kept_lines_give_the_same_tables(spark, small_dir):
    lazy, kept = raw_tables(spark, small_dir), raw_tables(spark, small_dir, kept=True)
    for name in lazy:
        assert lazy[name].columns == kept[name].columns
        assert lazy[name].exceptAll(kept[name]).isEmpty() and kept[name].exceptAll(lazy[name]).isEmpty()


def test_sales_and_marketing_share_their_joins(spark, small_dir):
    given = star_tables(spark, small_dir, kept=True)
    assert "Join" not in _plan(given.sales) and "Join" not in _plan(given.marketing)


def test_ridge_leaves_the_lines_where_they_are(spark, small_dir, monkeypatch):
    written = []
    plain = scratch.keep
    monkeypatch.setattr(forecasting, "keep", lambda df, name, *a, **b: written.append(name) or plain(df, name, *a, **b))
    queries.queries()["forecast_ridge"](spark, small_dir)
    assert "encoded_lines" not in written
