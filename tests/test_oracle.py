"""Registered queries against their SQL on the smallest test data.

The base reports share one workbench, so the fact is computed once; the command
``python -m checks.compare`` runs every query on its own.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from checks.compare import connect, difference
from checks.oracle import oracle_sql
from checks.queries import _last_demand, queries
from checks.star import VARIANTS
from stockloom import Workbench, planning_indicators, planning_table, product_forecast
from stockloom.operators.aggregates import DELIVERED_KEY

WITHOUT_SQL = {"forecast_forest", "forecast_boosting", "company_comparison", "model_comparison"}


@pytest.fixture(scope="module")
def duck(small_dir):
    return connect(small_dir)


def check(duck, name, df):
    assert difference(df.toPandas(), duck.sql(oracle_sql()[name]).df()) is None


def test_every_deterministic_query_has_sql():
    assert set(queries()) - set(oracle_sql()) == WITHOUT_SQL
    assert set(oracle_sql()) <= set(queries())
    assert set(__spark_entry__.queries()) >= set(queries())


@pytest.mark.parametrize("name", ["overview", "company_count", "demand_by_round", "sales_by_round", "profile_numeric", "profile_text", "last_round_stock"])
def test_exploration(duck, bench, name):
    check(duck, {"overview": "company_overview"}.get(name, name), getattr(bench, name)())


@pytest.mark.parametrize("name", ["company_overview", "demand_matrix", "sales_matrix", "demand_matrix_blocks", "sales_matrix_blocks", "demand_by_round", "profile_text"])
def test_exploration_of_the_sales_alone(spark, duck, small_dir, name):
    report = queries()[name](spark, small_dir)
    check(duck, name, report)
    scans = [line for line in report._jdf.queryExecution().toString().splitlines() if "FileScan" in line]
    assert not any("l_discount" in line or "o_totalprice" in line for line in scans)


def test_fact_and_features(duck, bench):
    check(duck, "sales_fact", bench.fact.drop(DELIVERED_KEY))
    check(duck, "demand_features", bench.features.drop("line_no"))
    check(duck, "company_list", bench.companies())


def test_known_totals(bench):
    """The sf0.001 column of FIXTURES.md."""
    sums = ("demand", "produced", "marketing_spend", "opening_stock")
    assert tuple(bench.fact.agg(F.count("*"), *[F.sum(c) for c in sums]).first()) == (
        5835, 147856.0, pytest.approx(18825.13), 37184791.0, 1167556.0,
    )
    assert bench.features.count() == 5710
    indicators = planning_indicators(bench.rounds, product_forecast(_last_demand(bench.features, bench.rounds)))
    totals = indicators.agg(F.count("*"), F.sum("forecast_demand"), F.sum("planned_production")).first()
    assert tuple(totals) == (79, 2809, pytest.approx(82787.91))


def test_planning(duck, bench):
    forecast = product_forecast(_last_demand(bench.features, bench.rounds))
    indicators = planning_indicators(bench.rounds, forecast)
    check(duck, "product_forecast", forecast)
    check(duck, "planning_indicators", indicators)
    check(duck, "planning_table", planning_table(indicators))


@pytest.mark.parametrize("variant", [v for v in VARIANTS if v != "base"])
def test_variants(spark, duck, small_dir, variant):
    check(duck, f"demand_features_{variant}", queries()[f"demand_features_{variant}"](spark, small_dir))


@pytest.mark.parametrize("name", ["sales_lines", "marketing_by_round", "market_price_company", "opening_stock_global", "forecast_metrics", "prepared_features", "prepared_features_with_gaps", "production_by_round", "report_export", "planning_identities", "forecast_checks", "forest_trees", "ridge_optimality", "csv_rejects", "csv_sales_lines"])
def test_other_queries(spark, duck, small_dir, name):
    check(duck, name, queries()[name](spark, small_dir))


def test_the_workbench_plans_with_a_model(bench):
    table = bench.planning_table("ridge")
    assert table.count() == bench.product_forecast("ridge").count() > 0
    assert bench.forecast("ridge") is bench.forecast("ridge")
    companies = {r.company for r in bench.companies().collect()}
    assert {r.company for r in bench.company_comparison("ridge").collect()} == companies
    assert {r.company for r in bench.metrics("ridge").collect()} == companies
    for report in ("financial_summary", "forecast_vs_history", "demand_timeline", "requirement_recap"):
        assert not getattr(bench, report)("ridge").isEmpty()


def test_one_company_on_its_own(bench):
    alone = Workbench(bench.tables, company="ASIA")
    every = bench.last_round_stock().where("company = 'ASIA'")
    assert sorted(alone.last_round_stock().collect()) == sorted(every.collect())
    with pytest.raises(ValueError, match="NOWHERE"):
        Workbench(bench.tables, company="NOWHERE").rounds


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
