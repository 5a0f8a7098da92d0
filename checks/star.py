"""The five input tables, derived from the star schema of the test data.

FIXTURES.md states the mapping; ``oracle.py`` states it again in SQL.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.sources.scratch import keep
from stockloom.sources.tables import Tables

VARIANTS = (
    "base",
    "market_by_company",
    "inventory_global",
    "no_quantity",
    "no_delivered",
    "minimal_sales",
)


# The columns that are read, with their types: without them every read would
# start a job to look into a file footer.
_READ = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _quarter_no(date: str) -> Column:
    return ((F.year(date) - 1995) * 4 + F.quarter(date)).cast("int")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_READ[table]).parquet(f"{sf_dir}/{table}.parquet")


def _places(spark: SparkSession, sf_dir: str, key: str, name: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias(key), F.col("r_name").alias(name)
    )


def _joined_lines(spark: SparkSession, sf_dir: str, supplier: DataFrame) -> DataFrame:
    """The lines with what the other tables say of them. Orders meet their customers and lines
    their suppliers first: the lines are the most rows, and only the joins to
    orders and parts move them."""
    read = partial(_read, spark, sf_dir)
    customer = read("customer").join(_places(spark, sf_dir, "c_nationkey", "customer_region"), "c_nationkey")
    orders = (
        read("orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", _quarter_no("o_orderdate").alias("quarter"), "c_mktsegment", "customer_region")
    )
    lines = (
        read("lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("tax_pct", F.round(F.col("l_tax") * 100).cast("int"))
        .select("l_orderkey", "l_partkey", "supplier_region", "l_linenumber", "l_quantity", "l_extendedprice", "tax_pct", "l_returnflag")
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .drop("l_orderkey", "o_orderkey", "l_partkey", "p_partkey")
    )


def _sales_view(lines: DataFrame) -> DataFrame:
    line_no, flag = F.col("l_linenumber"), F.col("l_returnflag")
    quantity, cost = F.col("l_quantity"), F.col("l_quantity") * F.col("p_size")
    taken_twice = (line_no == 1) & (flag == "A")
    return lines.select(
        F.col("quarter").alias("SIM_ROUND"),
        F.col("supplier_region").alias("SALES_ORGANIZATION"),
        F.col("p_brand").alias("MATERIAL_CODE"),
        F.col("c_mktsegment").alias("DISTRIBUTION_CHANNEL"),
        F.when(~((F.col("customer_region") == "ASIA") & (line_no == 7)), F.col("customer_region")).alias("AREA"),
        F.col("p_retailprice").alias("NET_PRICE"),
        F.col("l_extendedprice").alias("NET_VALUE"),
        cost.alias("COST"),
        F.when((line_no == 2) & (flag == "R"), F.lit(0.0)).otherwise(quantity).alias("QUANTITY"),
        F.when(flag == "R", quantity - 1).otherwise(quantity).alias("QUANTITY_DELIVERED"),
        (F.col("l_extendedprice") - cost).alias("CONTRIBUTION_MARGIN"),
        F.col("p_type").alias("MATERIAL_DESCRIPTION"),
        (quantity * F.col("tax_pct")).alias("AMOUNT"),
        F.explode(F.array_repeat(F.lit(1), F.when(taken_twice, 2).otherwise(1))).alias("COPY"),
    )


def star_tables(spark: SparkSession, sf_dir: str, variant: str = "base", kept: bool = False) -> Tables:
    """The five tables of one schema variant, lazily read and checked. With ``kept``, the joined
    lines that sales and marketing are made of are written first, and so are the suppliers'
    regions, for callers that read both."""
    return Tables.conform(**raw_tables(spark, sf_dir, variant, kept))


def raw_tables(spark: SparkSession, sf_dir: str, variant: str = "base", kept: bool = False) -> dict[str, DataFrame]:
    """The same with the headers they come with."""
    read = partial(_read, spark, sf_dir)
    supplier = read("supplier").join(_places(spark, sf_dir, "s_nationkey", "supplier_region"), "s_nationkey")
    if kept:
        # Spark takes the size of a join for the product of its sides and would move the lines for it.
        supplier = keep(supplier, "supplier_regions")
    lines = _joined_lines(spark, sf_dir, supplier)
    view = _sales_view(keep(lines, "joined_lines") if kept else lines)
    sales = view.drop("AMOUNT", "COPY")
    marketing = view.select("SIM_ROUND", "SALES_ORGANIZATION", "AMOUNT")

    production = (
        read("lineitem")
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("supplier_region").alias("COMPANY_CODE"),
            _quarter_no("l_shipdate").alias("SIM_ROUND"),
            F.col("p_brand").alias("MATERIAL_CODE"),
            (F.col("l_quantity") * F.col("l_discount")).alias("YIELD"),
        )
    )
    market = (
        read("orders")
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            _quarter_no("o_orderdate").alias("SIM_ROUND"),
            F.col("c_mktsegment").alias("DISTRIBUTION_CHANNEL"),
            F.col("o_totalprice").alias("AVERAGE_PRICE"),
        )
    )
    last_round = read("orders").agg(F.max(_quarter_no("o_orderdate")).alias("last")).first().last or 1
    inventory = read("part").select(
        F.explode(F.sequence(F.lit(1), F.lit(last_round))).alias("SIM_ROUND"),
        F.col("p_brand").alias("MATERIAL_CODE"),
        F.col("p_size").cast("double").alias("INVENTORY_OPENING_BALANCE"),
    )

    if variant == "market_by_company":
        market = sales.select(
            "SIM_ROUND",
            "DISTRIBUTION_CHANNEL",
            F.col("SALES_ORGANIZATION").alias("COMPANY_CODE"),
            F.col("NET_PRICE").alias("AVERAGE_PRICE"),
        )
    elif variant == "inventory_global":
        inventory = inventory.drop("MATERIAL_CODE")
    elif variant == "no_quantity":
        sales = sales.drop("QUANTITY")
    elif variant == "no_delivered":
        sales = sales.drop("QUANTITY_DELIVERED")
    elif variant == "minimal_sales":
        sales = sales.drop("AREA", "NET_PRICE", "CONTRIBUTION_MARGIN", "MATERIAL_DESCRIPTION")
    elif variant != "base":
        raise ValueError(f"unknown variant: {variant}")
    return {"sales": sales, "production": production, "inventory": inventory, "market": market, "marketing": marketing}
