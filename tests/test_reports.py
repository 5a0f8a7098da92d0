"""Exploration and planning reports on hand-made lines."""

from __future__ import annotations

import csv
import glob

import pytest
from pyspark.sql import functions as F

from stockloom import (
    company_list,
    company_overview,
    demand_by_round,
    demand_features,
    demand_matrix,
    demand_timeline,
    financial_summary,
    forecast_metrics,
    forecast_vs_history,
    last_round_stock,
    planning_indicators,
    planning_table,
    product_forecast,
    product_rounds,
    profile_numeric,
    profile_text,
    requirement_recap,
    sales_by_round,
    sales_fact,
    sales_matrix,
    write_report,
)
from stockloom.sources.scratch import keep

from .tables import tables


@pytest.fixture(scope="module")
def features(spark):
    return keep(demand_features(sales_fact(tables(spark))), "features")


@pytest.fixture(scope="module")
def rounds(features):
    return product_rounds(features)


@pytest.fixture(scope="module")
def indicators(spark, rounds):
    # q has no line in the last round of A; z has no line at all.
    forecast = spark.createDataFrame(
        [("A", "p", 40), ("A", "q", 3), ("A", "z", 5), ("B", "p", 0)], "company string, product string, forecast_demand bigint"
    )
    return keep(planning_indicators(rounds, forecast), "indicators")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_companies_come_from_complete_lines(spark):
    assert rows(company_list(tables(spark).sales), "company") == [("A",), ("B",)]


def test_overview(rounds):
    assert rows(company_overview(rounds).orderBy("company"), "company", "rounds", "products", "records") == [
        ("A", 3, 2, 5),
        ("B", 2, 1, 2),
    ]


def test_matrices_leave_gaps_empty(rounds):
    assert rows(demand_matrix(rounds, ["p", "q"]), "company", "round", "p", "q") == [
        ("A", 1, 4.0, None),
        ("A", 2, 2.0, 1.0),
        ("A", 3, 6.0, None),
        ("B", 1, 2.0, None),
        ("B", 2, 1.0, None),
    ]
    assert sales_matrix(rounds, ["q"]).columns == ["company", "round", "q"]
    assert rows(sales_matrix(rounds, ["p", "q"]).where("round = 2"), "company", "p", "q") == [("A", 10.0, 5.0), ("B", 3.0, None)]


def test_long_form_has_every_product(rounds):
    assert rows(demand_by_round(rounds), "company", "round", "product", "demand") == [
        ("A", 1, "p", 4.0),
        ("A", 2, "p", 2.0),
        ("A", 2, "q", 1.0),
        ("A", 3, "p", 6.0),
        ("B", 1, "p", 2.0),
        ("B", 2, "p", 1.0),
    ]
    of_round = rows(sales_by_round(rounds).where("round = 2"), "company", "product", "net_sales")
    assert of_round == [("A", "p", 10.0), ("A", "q", 5.0), ("B", "p", 3.0)]


def test_last_stock_is_the_one_after_the_first_line_of_the_last_round(rounds):
    stock = last_round_stock(rounds).orderBy("company", "product")
    assert rows(stock, "company", "product", "available_stock") == [("A", "p", 36.0), ("B", "p", 36.0)]


def test_numeric_profile(features):
    profile = profile_numeric(features)
    assert set(profile.columns) == {"company", "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"}
    skipped = {"round", "trend", "demand_lag1", "market_price_lag1", "marketing_lag1", "line_no"}
    assert not skipped & {r["column"] for r in profile.collect()}
    # demands of A: 4, 0, 2, 6, 1
    got = profile.where("company = 'A' and column = 'demand'")
    assert rows(got, "count", "mean", "std", "min", "q25", "q50", "q75", "max") == [
        (5, 2.6, 2.41, 0.0, 1.0, 2.0, 4.0, 6.0)
    ]


def test_text_profile_breaks_ties_by_value(spark, features):
    profile = profile_text(features).where("company = 'A'")
    got = {r["column"]: (r["count"], r["unique"], r["top"], r["frequency"]) for r in profile.collect()}
    assert got == {
        "company": (5, 1, "A", 5),
        "product": (5, 2, "p", 4),
        "channel": (5, 2, "x", 3),
        "area": (5, 2, "N", 4),
    }
    tied = spark.createDataFrame([("A", "b"), ("A", "a"), ("A", None)], "company string, t string")
    assert rows(profile_text(tied, ["t"]), "count", "unique", "top", "frequency") == [(2, 2, "a", 1)]


def test_forecast_is_summed_in_whole_units_and_sorted(spark):
    lines = spark.createDataFrame(
        [("A", "p", 1), ("A", "q", 5), ("A", "p", 4), ("A", "o", 5)], "company string, product string, forecast bigint"
    )
    assert rows(product_forecast(lines), "product", "forecast_demand") == [("o", 5), ("p", 5), ("q", 5)]


def test_indicators(indicators):
    columns = ("company", "product", "available_stock", "forecast_price", "mean_unit_cost", "planned_production",
               "forecast_revenue", "forecast_cost", "forecast_margin", "stock_cover_pct")
    got = {r[:2]: r[2:] for r in rows(indicators, *columns)}
    # p of A: sales 8 + 6 + 4 + 12 over deliveries 4 + 3 + 2 + 6; unit costs 1, 0, 1, 1.
    assert got["A", "p"] == (36.0, 2.0, 0.75, 4.0, 80.0, 30.0, 50.0, 90.0)
    assert got["A", "q"] == (0.0, 5.0, 1.0, 3.0, 15.0, 3.0, 12.0, 0.0)
    assert got["A", "z"] == (0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0)
    assert got["B", "p"][3] == 0.0 and got["B", "p"][7] == 0.0


def test_reports_on_indicators(indicators, rounds):
    assert rows(planning_table(indicators), "company", "product") == [("A", "p"), ("A", "z"), ("A", "q"), ("B", "p")]
    assert rows(financial_summary(indicators).orderBy("company"), "total_revenue", "total_margin") == [
        (95.0, 62.0),
        (0.0, 0.0),
    ]
    history = forecast_vs_history(indicators, rounds)
    assert rows(history, "product", "mean_past_demand") == [("p", 3.0), ("z", None), ("q", 1.0), ("p", 1.5)]
    assert rows(requirement_recap(indicators).where("product = 'q'"), "net_requirement") == [(3.0,)]
    timeline = demand_timeline(rounds, indicators).where("company = 'A'")
    assert rows(timeline, "round", "demand", "total_stock") == [
        (1, 4.0, 39.0),
        (2, 3.0, 78.0),
        (3, 6.0, 36.0),
        (4, 48.0, 36.0),
    ]


def test_metrics_with_a_constant_label(spark):
    lines = spark.createDataFrame(
        [("a", 2.0, 2.0), ("a", 2.0, 2.0), ("b", 2.0, 3.0), ("b", 2.0, 2.0), ("c", 1.0, 1.0), ("c", 3.0, 2.0)],
        "company string, demand double, prediction double",
    )
    metrics = forecast_metrics(lines, ("company",)).orderBy("company")
    assert rows(metrics, "test_lines", "mae", "r2") == [(2, 0.0, 1.0), (2, 0.5, 0.0), (2, 0.5, 0.5)]


def test_export_writes_one_folder_per_company_and_model(spark, indicators, tmp_path):
    path = f"{tmp_path}/report"
    write_report(planning_table(indicators), path, model="Random Forest")
    files = glob.glob(f"{path}/company=A/model=Random_Forest/*.csv")
    assert len(files) == 1
    with open(files[0], encoding="utf-8") as file:
        read = list(csv.DictReader(file))
    assert list(read[0]) == [c for c in planning_table(indicators).columns if c != "company"]
    assert {r["product"]: r["planned_production"] for r in read} == {"p": "4.0", "q": "3.0", "z": "5.0"}
    write_report(indicators, f"{tmp_path}/parquet", file_format="parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 4
    with pytest.raises(Exception, match="already exists"):
        write_report(indicators, path)


def test_totals_add_up_from_rounds(features, rounds):
    direct = features.agg(F.sum("demand"), F.sum("net_sales"), F.count("*")).first()
    rolled = rounds.agg(F.sum("demand").cast("double"), F.sum("net_sales").cast("double"), F.sum("lines")).first()
    assert tuple(direct) == tuple(rolled)
