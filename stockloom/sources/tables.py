"""The set of five input tables and the ways to read it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .contract import CONTRACTS, KEY, MEASURE, ORDINAL, clean_headers, conform

_CSV_TYPES = {ORDINAL: "double", MEASURE: "double", KEY: "string"}


@dataclass(frozen=True)
class Tables:
    """Checked input tables, lazily read, with our column names."""

    sales: DataFrame
    production: DataFrame
    inventory: DataFrame
    market: DataFrame
    marketing: DataFrame

    @classmethod
    def conform(cls, **raw: DataFrame) -> Tables:
        """Check and rename five raw tables given by name."""
        absent = sorted(set(CONTRACTS) - set(raw))
        if absent:
            raise ValueError(f"missing tables: {', '.join(absent)}")
        return cls(**{name: conform(raw[name], contract) for name, contract in CONTRACTS.items()})


def _read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    # Without schema inference: it would read the files twice and guess that a
    # product code such as 007 is a number. The listed columns get their types.
    df = clean_headers(spark.read.option("header", True).csv(path), table)
    kinds = {field.source: _CSV_TYPES[field.kind] for field in CONTRACTS[table].fields}
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns if c in kinds])


def read_tables(spark: SparkSession, root: str, file_format: str = "parquet") -> Tables:
    """Read ``<root>/sales``, ``<root>/production`` and so on."""
    raw = {}
    for table in CONTRACTS:
        path = f"{root.rstrip('/')}/{table}"
        raw[table] = (
            _read_csv(spark, path, table)
            if file_format == "csv"
            else spark.read.format(file_format).load(path)
        )
    return Tables.conform(**raw)


def catalog_tables(spark: SparkSession, database: str) -> Tables:
    """Read the five tables from a catalog database."""
    return Tables.conform(**{table: spark.table(f"{database}.{table}") for table in CONTRACTS})
