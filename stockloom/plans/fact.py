"""The enriched sales fact: sales lines with production, spend, price and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates
from ..operators.ordered import in_order
from ..sources.contract import require_matching_keys
from ..sources.scratch import keep_all
from ..sources.tables import Tables

FILLED = ("produced", "marketing_spend", "market_price", "opening_stock")


def _of_company(df: DataFrame, company) -> DataFrame:
    return df if company is None or "company" not in df.columns else df.where(F.col("company") == company)


def sales_fact(tables: Tables, company: str | None = None, ordered: bool = False) -> DataFrame:
    """One row per sales line, with the coarser tables joined on.

    With ``ordered``, the lines are numbered along their order before they are joined, and
    ``line_no`` and ``slice`` come with the fact: the lags need no order of the wider rows.

    With ``company``, every table that names companies is cut to it in its scan.

    The right sides are unique on their keys, so no line is multiplied. They are
    written once, all four at the same time: Spark then plans each join on the
    size of the written table, and a small one is broadcast without the lines
    being shuffled for it.
    """
    tables = Tables(**{name: _of_company(df, company) for name, df in vars(tables).items()})
    lines = aggregates.sales_lines(tables.sales, ranged=ordered)
    stock_is_global = "product" not in tables.inventory.columns
    sides = {
        "production": aggregates.production_by_round(tables.production),
        "marketing": aggregates.marketing_by_round(tables.marketing),
        "market": aggregates.market_price(tables.market),
        "stock": aggregates.opening_stock(tables.inventory),
    }
    for name, side in sides.items():
        require_matching_keys(lines, side, _shared(lines, side), name)
    fact = in_order(lines, aggregates.line_order(lines), "ordered_lines") if ordered else lines
    for side in keep_all(sides).values():
        fact = fact.join(side, _shared(lines, side), "left")
    if stock_is_global:
        fact = fact.withColumn("opening_stock", F.col("opening_stock_global"))
    numbers = [c for c in ("line_no", "slice") if c in fact.columns]
    fact = fact.select(*[c for c in fact.columns if c not in numbers], *numbers)
    return fact.fillna(0, subset=[c for c in FILLED if c in fact.columns])


def _shared(lines: DataFrame, side: DataFrame) -> list[str]:
    return [c for c in side.columns if c in ("company", "round", "product", "channel")]
