from __future__ import annotations

from pyspark.sql import functions as F

from stockloom import demand_features, running_stock, sales_fact, sales_lines
from stockloom.operators import aggregates

from .tables import raw, tables


def rows(df, *columns, order=None):
    return [tuple(r) for r in df.select(*columns).orderBy(*(order or columns)).collect()]


def test_equal_keys_collapse_and_missing_keys_drop(spark):
    lines = sales_lines(tables(spark).sales)
    assert lines.count() == 10
    assert rows(lines.where("company = 'A' and product = 'p' and round = 1"), "channel", "demand", "net_sales") == [
        ("x", 13.0, 20.0),
        ("y", 4.0, 8.0),
    ]


def test_groups_without_a_value(spark):
    t = tables(spark)
    production = aggregates.production_by_round(t.production)
    assert rows(production, "company", "round", "produced") == [("A", 1, 7.0), ("A", 2, 0.0), ("A", 3, 5.0)]
    market = spark.createDataFrame([(1, "x", None)], "SIM_ROUND int, DISTRIBUTION_CHANNEL string, AVERAGE_PRICE double")
    assert rows(aggregates.market_price(tables(spark, market=market).market), "market_price") == [(None,)]


def test_means_skip_missing_values(spark):
    prices = aggregates.market_price(tables(spark).market)
    assert rows(prices, "round", "channel", "market_price") == [(1, "x", 15.0), (1, "y", 8.0), (2, "x", 12.0)]


def test_the_fact_keeps_every_line_and_fills_misses(spark):
    fact = sales_fact(tables(spark))
    columns = ("company", "product", "round", "channel", "area", "produced", "marketing_spend", "market_price", "opening_stock")
    assert rows(fact, *columns) == [
        ("A", "p", 1, "x", "N", 7.0, 150.0, 15.0, 42.0),
        ("A", "p", 1, "y", "N", 7.0, 150.0, 8.0, 42.0),
        ("A", "p", 2, "x", "N", 0.0, 30.0, 12.0, 50.0),
        ("A", "p", 2, "y", "S", 0.0, 30.0, 0.0, 50.0),
        ("A", "p", 3, "x", "N", 5.0, 0.0, 0.0, 0.0),
        ("A", "q", 1, "x", "N", 0.0, 150.0, 15.0, 5.0),
        ("A", "q", 2, "x", "N", 0.0, 30.0, 12.0, 0.0),
        ("B", "p", 1, "x", "N", 0.0, 7.0, 15.0, 42.0),
        ("B", "p", 1, "x", "S", 0.0, 7.0, 15.0, 42.0),
        ("B", "p", 2, "x", "N", 0.0, 0.0, 12.0, 50.0),
    ]


def test_market_prices_per_company(spark):
    market = spark.createDataFrame(
        [(1, "x", 3.0, "A"), (1, "x", 4.0, "B")],
        "SIM_ROUND int, DISTRIBUTION_CHANNEL string, AVERAGE_PRICE double, COMPANY_CODE string",
    )
    fact = sales_fact(tables(spark, market=market)).where("round = 1 and channel = 'x'").distinct()
    assert set(rows(fact, "company", "market_price")) == {("A", 3.0), ("B", 4.0)}


def test_stock_without_products_is_a_mean_for_all(spark):
    inventory = raw(spark)["inventory"].drop("MATERIAL_CODE")
    fact = sales_fact(tables(spark, inventory=inventory))
    seen = set(rows(fact, "round", "opening_stock_global", "opening_stock"))
    assert seen == {(1, 261.75, 261.75), (2, 50.0, 50.0), (3, None, 0.0)}


def test_delivered_quantity_becomes_the_demand_if_it_is_the_only_one(spark):
    sales = raw(spark)["sales"].drop("QUANTITY")
    features = demand_features(sales_fact(tables(spark, sales=sales)))
    assert "qty_delivered" not in features.columns and aggregates.DELIVERED_KEY not in features.columns
    lines = sales_lines(tables(spark, sales=sales).sales)
    assert rows(lines.where("company = 'A' and product = 'p' and round = 1"), "channel", "demand") == [
        ("x", 20.0),
        ("y", 4.0),
    ]


def test_running_stock_starts_from_the_first_opening_stock(spark):
    stock = running_stock(sales_fact(tables(spark)))
    assert rows(stock, "company", "product", "round", "channel", "area", "running_stock") == [
        ("A", "p", 1, "x", "N", 36.0),  # 42 + 7 - 13
        ("A", "p", 1, "y", "N", 39.0),  # production counts again on every line
        ("A", "p", 2, "x", "N", 39.0),
        ("A", "p", 2, "y", "S", 37.0),
        ("A", "p", 3, "x", "N", 36.0),
        ("A", "q", 1, "x", "N", 3.0),
        ("A", "q", 2, "x", "N", 2.0),
        ("B", "p", 1, "x", "N", 39.0),
        ("B", "p", 1, "x", "S", 37.0),
        ("B", "p", 2, "x", "N", 36.0),
    ]


def test_lags_come_from_the_line_before_and_the_first_line_goes(spark):
    features = demand_features(sales_fact(tables(spark)))
    columns = ("company", "product", "round", "channel", "area", "demand_lag1", "market_price_lag1", "marketing_lag1", "trend")
    assert rows(features, *columns) == [
        ("A", "p", 1, "y", "N", 13.0, 15.0, 150.0, 1),
        ("A", "p", 2, "x", "N", 4.0, 8.0, 150.0, 2),
        ("A", "p", 2, "y", "S", 0.0, 12.0, 30.0, 2),
        ("A", "p", 3, "x", "N", 2.0, 0.0, 30.0, 3),
        ("A", "q", 2, "x", "N", 2.0, 15.0, 150.0, 2),
        ("B", "p", 1, "x", "S", 3.0, 15.0, 7.0, 1),
        ("B", "p", 2, "x", "N", 2.0, 15.0, 7.0, 2),
    ]


def test_one_company_is_the_same_as_its_part_of_all(spark):
    fact = sales_fact(tables(spark))
    every = demand_features(fact).drop("line_no")
    one = demand_features(fact, company="A").drop("line_no")
    assert sorted(one.collect()) == sorted(every.where("company = 'A'").collect())


def test_numeric_channels_become_text_after_ordering(spark):
    frames = raw(spark)
    number = "case DISTRIBUTION_CHANNEL when 'x' then 9 when 'y' then 10 end"
    changes = {
        t: frames[t].withColumn("DISTRIBUTION_CHANNEL", F.expr(number))
        for t in ("sales", "market")
    }
    features = demand_features(sales_fact(tables(spark, **changes)))
    assert dict(features.dtypes)["channel"] == "string"
    # 9 is before 10: ordered as numbers.
    assert rows(features.where("company = 'A' and product = 'p' and round = 1"), "channel", "demand_lag1") == [("10", 13.0)]
