"""From a forecast to planning tables: production, revenue, margin, stock cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import amount, at_least_zero, guarded_ratio, round_half_even
from ..operators.rollup import last_rounds, product_totals

FINAL_COLUMNS = (
    "company",
    "product",
    "forecast_demand",
    "available_stock",
    "planned_production",
    "forecast_price",
    "forecast_revenue",
    "forecast_margin",
    "stock_cover_pct",
)


def _largest_first(df: DataFrame) -> DataFrame:
    return df.orderBy("company", F.desc("forecast_demand"), "product")


def product_forecast(line_forecasts: DataFrame) -> DataFrame:
    """Forecast per company and product: the sum of the whole-unit line forecasts."""
    sums = line_forecasts.groupBy("company", "product").agg(F.sum("forecast").alias("forecast_demand"))
    return _largest_first(sums)


def planning_indicators(rounds: DataFrame, forecast: DataFrame) -> DataFrame:
    """All indicators per company and product of the forecast."""
    totals = product_totals(rounds)
    demand = F.col("forecast_demand")
    zero_if_missing = [
        F.coalesce(c, F.lit(0.0)).alias(c) for c in ("available_stock", "forecast_price", "mean_unit_cost")
    ]
    return (
        forecast.select("company", "product", "forecast_demand")
        .join(totals, ["company", "product"], "left")
        .select("company", "product", "forecast_demand", *zero_if_missing)
        .withColumn("planned_production", at_least_zero(demand - F.col("available_stock")))
        .withColumn("forecast_revenue", demand * F.col("forecast_price"))
        .withColumn("forecast_cost", demand * F.col("mean_unit_cost"))
        .withColumn("forecast_margin", F.col("forecast_revenue") - F.col("forecast_cost"))
        .withColumn(
            "stock_cover_pct", round_half_even(guarded_ratio("available_stock", demand) * 100, 1)
        )
    )


def planning_table(indicators: DataFrame) -> DataFrame:
    """The table that is shown and exported, largest forecast first."""
    return _largest_first(indicators.select(*FINAL_COLUMNS))


def financial_summary(indicators: DataFrame) -> DataFrame:
    """Total forecast revenue and margin of each company."""
    return indicators.groupBy("company").agg(
        F.sum(amount("forecast_revenue")).cast("double").alias("total_revenue"),
        F.sum(amount("forecast_margin")).cast("double").alias("total_margin"),
    )


def forecast_vs_history(indicators: DataFrame, rounds: DataFrame) -> DataFrame:
    """Forecast, stock and mean past demand of a line, per product."""
    history = product_totals(rounds).select("company", "product", "mean_past_demand")
    return _largest_first(
        indicators.select("company", "product", "forecast_demand", "available_stock").join(
            history, ["company", "product"], "left"
        )
    )


def demand_timeline(rounds: DataFrame, indicators: DataFrame) -> DataFrame:
    """Demand and stock per round, and one more round with the forecast."""
    past = rounds.groupBy("company", "round").agg(
        F.sum("demand").cast("double").alias("demand"),
        F.sum("running_stock").cast("double").alias("total_stock"),
    )
    ahead = (
        indicators.groupBy("company")
        .agg(
            F.sum(amount("forecast_demand")).cast("double").alias("demand"),
            F.sum(amount("available_stock")).cast("double").alias("total_stock"),
        )
        .join(last_rounds(rounds), "company")
        .select("company", (F.col("last_round") + 1).alias("round"), "demand", "total_stock")
    )
    return past.unionByName(ahead).orderBy("company", "round")


def requirement_recap(indicators: DataFrame) -> DataFrame:
    """What has to be produced, per product."""
    return indicators.select(
        "company",
        "product",
        "forecast_demand",
        "available_stock",
        "planned_production",
        "stock_cover_pct",
        F.col("planned_production").alias("net_requirement"),
    )
