"""A few hand-written rows for each input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom import Tables

SALES = (
    "SIM_ROUND int, SALES_ORGANIZATION string, MATERIAL_CODE string, DISTRIBUTION_CHANNEL string, "
    "AREA string, NET_PRICE double, NET_VALUE double, COST double, QUANTITY double, QUANTITY_DELIVERED double"
)
PRODUCTION = "COMPANY_CODE string, SIM_ROUND int, MATERIAL_CODE string, YIELD double"
MARKET = "SIM_ROUND int, DISTRIBUTION_CHANNEL string, AVERAGE_PRICE double"
MARKETING = "SIM_ROUND int, SALES_ORGANIZATION string, AMOUNT double"
INVENTORY = "SIM_ROUND int, MATERIAL_CODE string, INVENTORY_OPENING_BALANCE double"

SALES_ROWS = [
    # round, company, product, channel, area, price, value, cost, quantity, delivered
    (1, "A", "p", "x", "N", 2.0, 20.0, 5.0, 10.0, 10.0),
    (1, "A", "p", "x", "N", 2.0, 20.0, 5.0, 3.0, 10.0),  # equal keys: collapses with the line above
    (1, "A", "p", "y", "N", 2.0, 8.0, 4.0, 4.0, 4.0),
    (2, "A", "p", "x", "N", 2.0, 6.0, 3.0, 0.0, 3.0),  # no demand: no unit cost
    (2, "A", "p", "y", "S", 2.0, 4.0, 2.0, 2.0, 2.0),
    (2, "A", "q", "x", "N", 5.0, 5.0, 1.0, 1.0, 1.0),
    (3, "A", "p", "x", "N", 2.0, 12.0, 6.0, 6.0, 6.0),
    (1, "A", "q", "x", "N", 5.0, 10.0, 2.0, 2.0, 2.0),
    (1, "B", "p", "x", "N", 3.0, 9.0, 3.0, 3.0, 3.0),
    (1, "B", "p", "x", "S", 3.0, 6.0, 2.0, 2.0, 2.0),
    (2, "B", "p", "x", "N", 3.0, 3.0, 1.0, 1.0, 1.0),
    (2, "B", "p", "x", None, 3.0, 99.0, 9.0, 9.0, 9.0),  # missing key: dropped
    (2, None, "p", "x", "N", 3.0, 99.0, 9.0, 9.0, 9.0),  # missing key: dropped
]
PRODUCTION_ROWS = [
    ("A", 1, "p", 6.0),
    ("A", 1, "p", 1.0),
    ("A", 2, "p", None),  # nothing but missing yields: sums to 0
    ("A", 3, "p", 5.0),
    (None, 3, "p", 500.0),
]
MARKET_ROWS = [(1, "x", 10.0), (1, "x", 20.0), (1, "x", None), (1, "y", 8.0), (2, "x", 12.0), (2, None, 1.0)]
MARKETING_ROWS = [(1, "A", 100.0), (1, "A", 50.0), (2, "A", 30.0), (1, "B", 7.0)]
INVENTORY_ROWS = [(1, "p", 40.0), (1, "p", 2.0), (2, "p", 50.0), (1, "q", 5.0), (1, None, 1000.0)]


def raw(spark: SparkSession, **changes: DataFrame) -> dict[str, DataFrame]:
    return {
        "sales": spark.createDataFrame(SALES_ROWS, SALES),
        "production": spark.createDataFrame(PRODUCTION_ROWS, PRODUCTION),
        "market": spark.createDataFrame(MARKET_ROWS, MARKET),
        "marketing": spark.createDataFrame(MARKETING_ROWS, MARKETING),
        "inventory": spark.createDataFrame(INVENTORY_ROWS, INVENTORY),
        **changes,
    }


def tables(spark: SparkSession, **changes: DataFrame) -> Tables:
    return Tables.conform(**raw(spark, **changes))
