"""The grouped tables the fact is joined from.

Rows with a missing key are dropped before each grouping. All of these are plain
sums and means, so each executor reduces its rows before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.expressions import exact_mean, exact_sum

# The keys of a sales line. Together they identify it, and in this order they
# put the lines of one company in sequence once product and round lead.
LINE_KEYS = (
    "round",
    "company",
    "product",
    "channel",
    "area",
    "net_price",
    "net_sales",
    "cost",
    "qty_delivered",
    "contribution_margin",
    "product_name",
)
LINE_ORDER = ("company", "product", "round") + tuple(
    key for key in LINE_KEYS if key not in ("company", "product", "round")
)
# Stands in for qty_delivered where that column became the demand itself: the
# lines are still told apart, and ordered, by it.
DELIVERED_KEY = "delivered_key"


def _grouped(df: DataFrame, keys: list[str]):
    return df.dropna(subset=keys).groupBy(*keys)


def sales_lines(sales: DataFrame, ranged: bool = False) -> DataFrame:
    """Sales lines: rows equal in every key collapse and their quantity adds up.

    With ``ranged``, the rows are range-partitioned along the order of the lines and collapse
    where they are, so that putting the lines in order moves nothing: where few rows
    are equal, that is one exchange instead of two.
    """
    keys = [key for key in LINE_KEYS if key in sales.columns]
    if ranged:
        sales = sales.dropna(subset=keys).repartitionByRange(*[key for key in LINE_ORDER if key in keys])
    if "quantity" in sales.columns:
        return _grouped(sales, keys).agg(exact_sum("quantity").cast("double").alias("demand"))
    return (
        _grouped(sales, keys)
        .agg(exact_sum("qty_delivered").cast("double").alias("demand"))
        .withColumnRenamed("qty_delivered", DELIVERED_KEY)
    )


def line_order(fact: DataFrame) -> list[str]:
    """The columns that put the lines of a fact in their total order."""
    named = [DELIVERED_KEY if k == "qty_delivered" and k not in fact.columns else k for k in LINE_ORDER]
    return [key for key in named if key in fact.columns]


def production_by_round(production: DataFrame) -> DataFrame:
    return _grouped(production, ["company", "round", "product"]).agg(
        exact_sum("produced").cast("double").alias("produced")
    )


def marketing_by_round(marketing: DataFrame) -> DataFrame:
    return _grouped(marketing, ["round", "company"]).agg(
        exact_sum("marketing_spend").cast("double").alias("marketing_spend")
    )


def market_price(market: DataFrame) -> DataFrame:
    """Mean market price per round and channel, per company where it is given."""
    keys = ["round", "channel"] + (["company"] if "company" in market.columns else [])
    return _grouped(market, keys).agg(exact_mean("market_price").alias("market_price"))


def opening_stock(inventory: DataFrame) -> DataFrame:
    """Opening stock: summed per round and product, or averaged per round if
    the inventory does not tell products apart."""
    if "product" in inventory.columns:
        return _grouped(inventory, ["round", "product"]).agg(
            exact_sum("opening_stock").cast("double").alias("opening_stock")
        )
    return _grouped(inventory, ["round"]).agg(
        exact_mean("opening_stock").alias("opening_stock_global")
    )
