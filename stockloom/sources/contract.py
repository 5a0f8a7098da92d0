"""The five input tables: their columns, our names for them, and what is checked.

A table may carry more columns than listed here (they are not read) and may lack
the optional ones. Everything is checked on the schema alone, before any job.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

ORDINAL = "round number"
KEY = "key"
MEASURE = "number"


class ContractError(ValueError):
    """An input table does not have the columns or types the plans need."""


@dataclass(frozen=True)
class Field:
    source: str
    name: str
    kind: str
    required: bool = True


@dataclass(frozen=True)
class Contract:
    table: str
    fields: tuple[Field, ...]
    # At least one of these must be there.
    one_of: tuple[str, ...] = ()


SALES = Contract(
    "sales",
    (
        Field("SIM_ROUND", "round", ORDINAL),
        Field("SALES_ORGANIZATION", "company", KEY),
        Field("MATERIAL_CODE", "product", KEY),
        Field("DISTRIBUTION_CHANNEL", "channel", KEY),
        Field("AREA", "area", KEY, required=False),
        Field("NET_PRICE", "net_price", MEASURE, required=False),
        Field("NET_VALUE", "net_sales", MEASURE),
        Field("COST", "cost", MEASURE),
        Field("QUANTITY", "quantity", MEASURE, required=False),
        Field("QUANTITY_DELIVERED", "qty_delivered", MEASURE, required=False),
        Field("CONTRIBUTION_MARGIN", "contribution_margin", MEASURE, required=False),
        Field("MATERIAL_DESCRIPTION", "product_name", KEY, required=False),
    ),
    one_of=("quantity", "qty_delivered"),
)
PRODUCTION = Contract(
    "production",
    (
        Field("COMPANY_CODE", "company", KEY),
        Field("SIM_ROUND", "round", ORDINAL),
        Field("MATERIAL_CODE", "product", KEY),
        Field("YIELD", "produced", MEASURE),
    ),
)
MARKET = Contract(
    "market",
    (
        Field("COMPANY_CODE", "company", KEY, required=False),
        Field("SIM_ROUND", "round", ORDINAL),
        Field("DISTRIBUTION_CHANNEL", "channel", KEY),
        Field("AVERAGE_PRICE", "market_price", MEASURE),
    ),
)
MARKETING = Contract(
    "marketing",
    (
        Field("SIM_ROUND", "round", ORDINAL),
        Field("SALES_ORGANIZATION", "company", KEY),
        Field("AMOUNT", "marketing_spend", MEASURE),
    ),
)
INVENTORY = Contract(
    "inventory",
    (
        Field("SIM_ROUND", "round", ORDINAL),
        Field("MATERIAL_CODE", "product", KEY, required=False),
        Field("INVENTORY_OPENING_BALANCE", "opening_stock", MEASURE),
    ),
)
CONTRACTS = {c.table: c for c in (SALES, PRODUCTION, INVENTORY, MARKET, MARKETING)}


def clean_headers(df: DataFrame, table: str = "table") -> DataFrame:
    """Strip and upper-case the headers; two headers must not become one."""
    headers = [name.strip().upper() for name in df.columns]
    twice = sorted(name for name, n in Counter(headers).items() if n > 1)
    if twice:
        raise ContractError(f"{table}: headers are not unique once cleaned: {', '.join(twice)}")
    return df.toDF(*headers)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _typed(field: Field, kind: T.DataType, table: str) -> Column:
    column = F.col(f"`{field.source}`")
    if isinstance(kind, T.NullType):
        kind = T.DoubleType() if field.kind != KEY else T.StringType()
    if field.kind == KEY:
        if not isinstance(kind, (T.StringType, T.NumericType)):
            raise ContractError(f"{table}.{field.source} must be text or a number, not {kind.simpleString()}")
    elif not is_number(kind):
        raise ContractError(f"{table}.{field.source} must be a number, not {kind.simpleString()}")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # A missing number may be written as NaN or be the infinity of a division by
        # zero; it is a null like any other.
        column = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
    if field.kind == ORDINAL:
        if isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        else:
            # Rounds are counted: half a round is a mistake in the input.
            text = F.concat(F.lit(f"{table}.{field.source} must be whole: "), column.cast("string"))
            column = F.when(column.isNull() | (column == F.floor(column)), column.cast("bigint")).otherwise(F.raise_error(text))
    elif field.kind == MEASURE:
        column = column.cast("double")
    return column.alias(field.name)


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """Clean the headers, keep the listed columns that exist, and rename them."""
    df = clean_headers(df, contract.table)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.source for f in contract.fields if f.required and f.source not in kinds]
    if missing:
        raise ContractError(f"{contract.table}: missing columns: {', '.join(missing)}")
    present = [f for f in contract.fields if f.source in kinds]
    if contract.one_of and not any(f.name in contract.one_of for f in present):
        choices = [f.source for f in contract.fields if f.name in contract.one_of]
        raise ContractError(f"{contract.table}: needs one of {', '.join(choices)}")
    return df.select(*[_typed(f, kinds[f.source], contract.table) for f in present])


def require_matching_keys(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Text and numeric keys never match; say so instead of casting one of them."""
    for key in keys:
        sides = [df.schema[key].dataType for df in (left, right)]
        if is_number(sides[0]) != is_number(sides[1]):
            names = " and ".join(side.simpleString() for side in sides)
            raise ContractError(f"{what}: key {key} is {names}; both must be text or both numbers")
