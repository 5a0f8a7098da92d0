"""The per-round table all planning and exploration reports start from.

One pass over the lines brings them down to one row per company, product and
round. The sums stay fixed-point numbers, so adding them up again gives the same
result as adding up the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import amount, exact_ratio_sum, exact_sum, guarded_ratio
from ..sources.scratch import keep
from .aggregates import line_order


def product_rounds(features: DataFrame) -> DataFrame:
    """Sums, line count and first running stock per company, product and round.

    Written once: it is small against the lines, and most reports read it twice.
    """
    quantity = "qty_delivered" if "qty_delivered" in features.columns else "demand"
    rounds = features.groupBy("company", "product", "round").agg(
        F.count(F.lit(1)).alias("lines"),
        exact_sum("demand").alias("demand"),
        exact_sum("net_sales").alias("net_sales"),
        exact_sum(quantity).alias("quantity"),
        exact_ratio_sum(guarded_ratio("cost", "demand")).alias("unit_costs"),
        exact_sum("running_stock").alias("running_stock"),
        F.min_by("running_stock", "line_no").alias("first_running_stock"),
    )
    return keep(rounds, "product_rounds")


def first_lines(lines: DataFrame) -> DataFrame:
    """The first line of each company and product, in the order of the lines."""
    order = line_order(lines)
    rest = [c for c in lines.columns if c not in order]
    first = lines.groupBy("company", "product").agg(F.min(F.struct(*order[2:], *rest)).alias("first"))
    return first.select("company", "product", "first.*").select(*lines.columns)


def sales_rounds(lines: DataFrame) -> DataFrame:
    """Line count, demand and net sales per company, product and round.

    The same numbers as in ``product_rounds``, from the sales lines alone: the features
    are all lines but the first of each product.
    """
    first = first_lines(lines).select(
        "company", "product", "round", F.lit(1).alias("lines"), amount("demand").alias("demand"), amount("net_sales").alias("net_sales")
    )
    every = lines.groupBy("company", "product", "round").agg(
        F.count(F.lit(1)).alias("lines"), exact_sum("demand").alias("demand"), exact_sum("net_sales").alias("net_sales")
    )
    taken = every.join(first.toDF("company", "product", "round", "l", "d", "s"), ["company", "product", "round"], "left")
    zero = F.lit(0)
    return taken.select(
        "company",
        "product",
        "round",
        (F.col("lines") - F.coalesce("l", zero)).alias("lines"),
        (F.col("demand") - F.coalesce("d", zero)).alias("demand"),
        (F.col("net_sales") - F.coalesce("s", zero)).alias("net_sales"),
    ).where("lines > 0")


def last_rounds(rounds: DataFrame) -> DataFrame:
    """The last round of each company. An aggregate that is joined back: a
    window over the company would gather all of its rows in one task."""
    return rounds.groupBy("company").agg(F.max("round").alias("last_round"))


def product_totals(rounds: DataFrame) -> DataFrame:
    """One row per company and product: price, unit cost, mean demand, last stock.

    * ``forecast_price``: all net sales over all quantity, 0 without quantity;
    * ``mean_unit_cost``: mean over the lines of cost per unit of demand;
    * ``mean_past_demand``: mean demand of a line;
    * ``available_stock``: running stock after the first line of the company's
      last round, null for a product without a line in it.
    """
    in_last_round = F.col("round") == F.col("last_round")
    lines = F.sum("lines").cast("double")
    return (
        rounds.join(last_rounds(rounds), "company")
        .groupBy("company", "product")
        .agg(
            guarded_ratio(F.sum("net_sales"), F.sum("quantity")).alias("forecast_price"),
            (F.sum("unit_costs").cast("double") / lines).alias("mean_unit_cost"),
            (F.sum("demand").cast("double") / lines).alias("mean_past_demand"),
            F.max(F.when(in_last_round, F.col("first_running_stock"))).alias("available_stock"),
        )
    )
