"""CSV files with bad cells: what cannot be read goes into a table instead of ending the load.

A cell is bad if its column holds numbers and its text is none, or if it is a round that is
not whole. A row with a bad cell is left out of its table and listed, once per bad cell, in
the rejects. Blank cells are missing values, as empty ones are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .contract import CONTRACTS, KEY, ORDINAL, Contract, ContractError, Field, clean_headers
from .scratch import keep
from .tables import Tables

#: Whole numbers beyond this one are not exact as doubles.
_MOST_ROUND = 2.0**53
_BAD = "array<struct<field:string,cell:string,reason:string>>"


@dataclass(frozen=True)
class Loaded:
    """The tables without the rejected rows, and the rejects: table_name, field, cell, reason, row_text."""

    tables: Tables
    rejects: DataFrame


def _number(field: Field) -> Column:
    text = F.trim(F.col(f"`{field.source}`"))
    return F.when(text != "", text.try_cast("double"))


def _bad_cell(field: Field) -> Column:
    """What is wrong with a cell; null if nothing is."""
    cell, number = F.col(f"`{field.source}`"), _number(field)
    reason = F.when((F.trim(cell) != "") & number.isNull(), "not a number")
    if field.kind == ORDINAL:
        finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
        whole = (number == F.floor(number)) & (F.abs(number) <= _MOST_ROUND)
        reason = reason.when(finite & ~whole, "not a whole number")
    return F.when(reason.isNotNull(), F.struct(F.lit(field.source).alias("field"), cell.alias("cell"), reason.alias("reason")))


def screen(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Splits a table of texts: rows of numbers and keys, and one row per bad cell.

    Both are lazy and read ``df`` on their own; nothing is shuffled. Columns that the contract
    does not list are left out of the rows and stay in ``row_text``, a JSON object of the
    whole row. Repeated rows are rejected as often as they occur; an empty table has no rejects.
    """
    df = clean_headers(df, contract.table)
    present = [field for field in contract.fields if field.source in df.columns]
    cells = [_bad_cell(field) for field in present if field.kind != KEY]
    bad = F.filter(F.array(*cells), lambda cell: cell.isNotNull()) if cells else F.array().cast(_BAD)
    # Beside the row and not among its columns, which may have any names.
    screened = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), bad.alias("bad"))
    typed = [F.col(f"`{f.source}`") if f.kind == KEY else _number(f).alias(f.source) for f in present]
    rows = screened.where(F.size("bad") == 0).select("row.*").select(*typed)
    rejects = screened.where(F.size("bad") > 0).select(
        F.lit(contract.table).alias("table_name"), F.inline("bad"), F.to_json("row").alias("row_text")
    )
    return rows, rejects


def read_csv_tables(spark: SparkSession, root: str, most: int | None = None) -> Loaded:
    """Read ``<root>/sales``, ``<root>/production`` and so on, CSV with a header.

    The rejects are written before anything else is read. More than ``most`` bad cells, in all
    tables together, are an error that names their number by column; None allows any.
    """
    raw, rejects = {}, []
    for table, contract in CONTRACTS.items():
        # All columns as texts: no pass over the files to guess their types.
        rows, bad = screen(spark.read.option("header", True).csv(f"{root.rstrip('/')}/{table}"), contract)
        raw[table] = rows
        rejects.append(bad)
    # Checked first: missing columns are an error before any job over the rows.
    tables = Tables.conform(**raw)
    written = keep(reduce(DataFrame.unionByName, rejects), "rejects")
    if most is not None:
        # One row per column of the contract at the most.
        counts = written.groupBy("table_name", "field").count().orderBy("table_name", "field").collect()
        if sum(row["count"] for row in counts) > most:
            found = ", ".join(f"{row.table_name}.{row.field}: {row['count']}" for row in counts)
            raise ContractError(f"more than {most} bad cells ({found})")
    return Loaded(tables, written)
