"""Model inputs: missing values, scale and category slots, per company.

All statistics come from the training rows (every round but the company's last)
and are computed for all companies at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import exact_mean
from ..sources.contract import is_number
from ..sources.scratch import keep
from .ordered import along_order, in_order
from .quantiles import exact_quantiles
from .rollup import last_rounds

TARGET = "demand"
DEFAULT_FEATURES = (
    "demand_lag1",
    "net_price",
    "market_price_lag1",
    "marketing_spend",
    "marketing_lag1",
    "cost",
    "trend",
    "product",
    "area",
    "net_sales",
)
NO_SLOT = -1


def long_form(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """One row per line and column: ``company``, ``column``, ``value``."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select("company", F.inline(F.array(*pairs)))


@dataclass(frozen=True)
class Encoded:
    """Encoded lines with what was measured on the training rows.

    ``lines`` has ``company``, ``product``, ``round``, ``line_no``, the target,
    ``is_test``, and per feature ``<name>_scaled`` or ``<name>_slot``. A slot is
    the place of a category in the sorted training categories less the first;
    the first one, and any category not seen in training, has ``NO_SLOT``.
    ``statistics`` has one row per company, ``categories`` one per category.
    """

    lines: DataFrame
    statistics: DataFrame
    categories: DataFrame | None
    numbers: list[str]
    texts: list[str]


def mark_test_rows(features: DataFrame) -> DataFrame:
    """The company's last round is for testing, everything before for training."""
    last = keep(last_rounds(features), "last_rounds")
    return (
        features.join(last, "company")
        .withColumn("is_test", F.col("round") == F.col("last_round"))
        .drop("last_round")
    )


def _in_training(value: Column | str) -> Column:
    return F.when(~F.col("is_test"), F.col(value) if isinstance(value, str) else value)


def _measure(lines: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    target = _in_training(TARGET)
    return lines.groupBy("company").agg(
        F.count(target).alias("n_train"),
        F.count_if("is_test").alias("n_test"),
        F.coalesce(F.stddev_pop(target), F.lit(0.0)).alias("target_std"),
        F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("target_sample_std"),
        *[exact_mean(_in_training(c)).alias(f"{c}__mean") for c in numbers],
        *[F.stddev_pop(_in_training(c)).alias(f"{c}__std") for c in numbers],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__missing") for c in [*numbers, *texts]],
    )


def _fill(lines: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Fill numbers with the training median, texts with the most frequent value."""
    training = lines.where(~F.col("is_test"))
    columns = [*numbers, *texts]
    fillers = lines.select("company").distinct()
    if numbers:
        medians = exact_quantiles(training, ["company"], numbers, [0.5])
        fillers = fillers.join(
            medians.groupBy("company").agg(
                *[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(f"{c}__fill") for c in numbers]
            ),
            "company",
            "left",
        )
    if texts:
        modes = (
            long_form(training, texts, "string")
            .dropna()
            .groupBy("company", "column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("company", "column")
            .agg(F.min(F.struct((-F.col("n")).alias("order"), "value"))["value"].alias("value"))
        )
        fillers = fillers.join(
            modes.groupBy("company").agg(
                *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"{c}__fill") for c in texts]
            ),
            "company",
            "left",
        )
    filled = lines.join(keep(fillers, "fill_values"), "company", "left")
    return filled.withColumns({c: F.coalesce(c, f"{c}__fill") for c in columns}).drop(
        *[f"{c}__fill" for c in columns]
    )


def _slots(lines: DataFrame, texts: list[str]) -> DataFrame:
    """Training categories in sorted order, numbered from ``NO_SLOT`` up."""
    seen = long_form(lines.where(~F.col("is_test")), texts, "string").dropna().distinct()
    ordered = in_order(seen, ["company", "column", "value"], "categories")
    counted = along_order(ordered, ["company", "column"], running={"place": F.lit(1)})
    return counted.select("company", "column", "value", (F.col("place") + (NO_SLOT - 1)).cast("int").alias("slot"))


def encode(features: DataFrame, columns: tuple[str, ...] | None = None) -> Encoded:
    """Encode the features that exist among ``columns``."""
    wanted = [c for c in (columns or DEFAULT_FEATURES) if c in features.columns]
    numbers = [c for c in wanted if is_number(features.schema[c].dataType)]
    texts = [c for c in wanted if c not in numbers]

    lines = mark_test_rows(features)
    statistics = keep(_measure(lines, numbers, texts), "training_statistics")
    missing = statistics.agg(*[F.sum(f"{c}__missing").alias(c) for c in wanted]).first()
    gaps = [c for c in wanted if missing is not None and missing[c]]
    if gaps:
        lines = _fill(lines, [c for c in numbers if c in gaps], [c for c in texts if c in gaps])
        statistics = keep(_measure(lines, numbers, texts), "training_statistics")

    encoded = lines.join(statistics.drop(*[f"{c}__missing" for c in wanted]), "company")
    scaled = []
    for c in numbers:
        std = F.col(f"{c}__std")
        # A constant has no spread to divide by.
        scaled.append(((F.col(c) - F.col(f"{c}__mean")) / F.when(std == 0, 1.0).otherwise(std)).alias(f"{c}_scaled"))
    categories = None
    if texts:
        categories = keep(_slots(lines, texts), "category_slots")
        for c in texts:
            slots = categories.where(F.col("column") == c).select(
                "company", F.col("value").alias(c), F.col("slot").alias(f"{c}_slot")
            )
            encoded = encoded.join(slots, ["company", c], "left")
    return Encoded(
        encoded.select(
            "company",
            "product",
            "round",
            "line_no",
            TARGET,
            "is_test",
            *scaled,
            *[F.coalesce(f"{c}_slot", F.lit(NO_SLOT)).alias(f"{c}_slot") for c in texts],
        ),
        statistics,
        categories,
        numbers,
        texts,
    )
