"""Running stock and lag features per company and product."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import MILLIONTH, millionths, units
from ..operators.aggregates import DELIVERED_KEY, line_order
from ..operators.ordered import along_order, in_order

LAGS = {
    "demand_lag1": "demand",
    "market_price_lag1": "market_price",
    "marketing_lag1": "marketing_spend",
}


def line_history(fact: DataFrame, company: str | None = None) -> DataFrame:
    """Every line with its running stock and the values of the line before.

    Stock after a line is the first opening stock of the product plus everything
    produced minus everything demanded up to and including that line. ``line_no``
    numbers the lines in their order and comes with the result. A fact that is ordered
    already brings its own.
    """
    if company is not None:
        fact = fact.where(F.col("company") == company)
    ordered = fact if {"line_no", "slice"} <= set(fact.columns) else in_order(fact, line_order(fact), "ordered_lines")
    # Summed as whole units and millionths, so that the slices do not show in
    # the last digits.
    history = along_order(
        ordered,
        ["company", "product"],
        running={
            "whole": units("produced") - units("demand"),
            "parts": millionths("produced") - millionths("demand"),
        },
        previous=LAGS,
        first={"first_stock": "opening_stock"},
    )
    moved = F.col("whole").cast("decimal(20,0)") + F.col("parts").cast("decimal(20,0)") * F.lit(MILLIONTH)
    stock = F.col("first_stock") + moved.cast("double")
    return history.withColumn("running_stock", F.coalesce(stock, F.lit(0.0))).drop(
        "slice", "whole", "parts", "first_stock", DELIVERED_KEY
    )


def running_stock(fact: DataFrame, company: str | None = None) -> DataFrame:
    """The fact with the running stock of each line."""
    return line_history(fact, company).drop(*LAGS)


def demand_features(fact: DataFrame, company: str | None = None) -> DataFrame:
    """Lines ready for exploration and forecasting.

    The first line of each company and product has no line before it and is
    dropped, after the running stock has taken it into account.
    """
    return (
        line_history(fact, company)
        .withColumn("channel", F.col("channel").cast("string"))
        .withColumn("trend", F.col("round"))
        .dropna(how="any", subset=list(LAGS))
    )
