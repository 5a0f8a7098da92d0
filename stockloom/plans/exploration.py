"""Exploration of the prepared lines, one row or matrix per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import exact_mean, round_half_even
from ..operators import aggregates
from ..operators.aggregates import LINE_KEYS
from ..operators.encoding import long_form
from ..operators.ordered import along_order, in_order
from ..operators.quantiles import exact_quantiles
from ..operators.rollup import first_lines, last_rounds
from ..sources.contract import is_number
from .features import LAGS

# Left out of the numeric profile: the round and what was derived for the models.
NOT_PROFILED = (*LAGS, "trend", "round", "line_no")
QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def company_list(sales: DataFrame) -> DataFrame:
    """Companies with at least one complete sales line, sorted.

    Every line of the fact comes from such a line, so the fact is not needed.
    """
    keys = [key for key in LINE_KEYS if key in sales.columns]
    return sales.dropna(subset=keys).select("company").distinct().orderBy("company")


def company_count(sales: DataFrame) -> DataFrame:
    """How many companies have a complete sales line."""
    return company_list(sales).agg(F.count(F.lit(1)).alias("companies"))


def company_overview(rounds: DataFrame) -> DataFrame:
    """Rounds, products and lines of each company."""
    return rounds.groupBy("company").agg(
        F.count_distinct("round").alias("rounds"),
        F.count_distinct("product").alias("products"),
        F.sum("lines").alias("records"),
    )


def _by_round(rounds: DataFrame, measure: str) -> DataFrame:
    sums = rounds.groupBy("company", "round", "product").agg(F.sum(measure).cast("double").alias(measure))
    return sums.orderBy("company", "round", "product")


def demand_by_round(rounds: DataFrame) -> DataFrame:
    """Demand per round and product, one row each, however many products there are."""
    return _by_round(rounds, "demand")


def sales_by_round(rounds: DataFrame) -> DataFrame:
    """Net sales per round and product, one row each."""
    return _by_round(rounds, "net_sales")


def _matrix(rounds: DataFrame, measure: str, products: list) -> DataFrame:
    spread = rounds.groupBy("company", "round").pivot("product", products)
    return spread.agg(F.sum(measure).cast("double")).orderBy("company", "round")


def demand_matrix(rounds: DataFrame, products: list) -> DataFrame:
    """Demand per round (rows) and chosen product (columns); null where there is none."""
    return _matrix(rounds, "demand", products)


def sales_matrix(rounds: DataFrame, products: list) -> DataFrame:
    """Net sales per round (rows) and chosen product (columns); null where there are none."""
    return _matrix(rounds, "net_sales", products)


def matrix_blocks(rounds: DataFrame, measure: str, width: int = 1000) -> DataFrame:
    """A matrix of any number of products: company, round, block and ``cells``, a map of product to value.

    The products of a company stand in the order of their names, ``width`` to a block (from 0);
    a round has a row for each block in which it has a product, and no cell where
    there is none. The names are numbered in slices, so nothing is collected and no row outgrows
    a block. Lines without a product are in no cell; no lines give no row.
    """
    if width < 1:
        raise ValueError("a block has at least one product")
    rounds = rounds.where(F.col("product").isNotNull())
    names = in_order(rounds.select("company", "product").distinct(), ["company", "product"], "matrix_products")
    places = along_order(names, ["company"], running={"place": F.lit(1)})
    blocks = places.select("company", "product", F.floor((F.col("place") - 1) / width).cast("int").alias("block"))
    sums = rounds.groupBy("company", "round", "product").agg(F.sum(measure).cast("double").alias("value"))
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct("product", "value"))))
    return sums.join(blocks, ["company", "product"]).groupBy("company", "round", "block").agg(cells.alias("cells"))


def numeric_columns(features: DataFrame, leave_out: tuple[str, ...] = NOT_PROFILED) -> list[str]:
    return [f.name for f in features.schema.fields if is_number(f.dataType) and f.name not in leave_out]


def text_columns(features: DataFrame) -> list[str]:
    return [f.name for f in features.schema.fields if f.dataType.simpleString() == "string"]


def profile_numeric(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each number.

    One row per company and column. Everything but the quartiles comes from one
    pass; the lines are read several times, so keep them first.
    """
    columns = columns or numeric_columns(features)
    if not columns:
        names = ("mean", "std", "min", "q25", "q50", "q75", "max")
        nothing = ", ".join(f"{name} double" for name in names)
        return features.sparkSession.createDataFrame([], f"company string, column string, count bigint, {nothing}")

    def summary(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(value).alias("count"),
            exact_mean(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )

    wide = features.groupBy("company").agg(F.array(*[summary(c) for c in columns]).alias("summaries"))
    summaries = wide.select("company", F.inline("summaries"))
    quartiles = (
        exact_quantiles(features, ["company"], columns, list(QUARTILES))
        .groupBy("company", "column")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for p, n in QUARTILES.items()])
    )
    rounded = [round_half_even(c, 2).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return summaries.join(quartiles, ["company", "column"], "left").select("company", "column", "count", *rounded)


def profile_text(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, distinct values, most frequent value and its count of each text.

    The smallest of equally frequent values is the most frequent one.
    """
    columns = columns or text_columns(features)
    counted = _value_counts(features, columns)
    return _text_summary(counted)


def profile_sales_text(sales: DataFrame) -> DataFrame:
    """The same from the sales table alone: the texts of all lines, less those of each
    product's first line. No other table and no order of all lines is needed."""
    lines = aggregates.sales_lines(sales)
    lines = lines.withColumn("channel", F.col("channel").cast("string"))
    columns = text_columns(lines)
    counted = (
        _value_counts(lines, columns)
        .unionByName(_value_counts(first_lines(lines), columns).withColumn("n", -F.col("n")))
        .groupBy("company", "column", "value")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
    return _text_summary(counted)


def _value_counts(lines: DataFrame, columns: list[str]) -> DataFrame:
    return (
        long_form(lines, columns, "string")
        .dropna()
        .groupBy("company", "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _text_summary(counted: DataFrame) -> DataFrame:
    return (
        counted.groupBy("company", "column")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("n")).alias("order"), "value")).alias("top"),
        )
        .select(
            "company", "column", "count", "unique",
            F.col("top.value").alias("top"), (-F.col("top.order")).alias("frequency"),
        )
    )


def last_round_stock(rounds: DataFrame) -> DataFrame:
    """Running stock per product at the company's last round: after its first line."""
    return (
        rounds.join(last_rounds(rounds), "company")
        .where(F.col("round") == F.col("last_round"))
        .select("company", "product", F.col("first_running_stock").alias("available_stock"))
    )
