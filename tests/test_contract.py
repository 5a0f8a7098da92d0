from __future__ import annotations

import pytest

from stockloom import ContractError, Tables, catalog_tables, read_tables, sales_fact
from stockloom.sources.contract import SALES, clean_headers, conform

from .tables import raw, tables


def test_headers_are_stripped_and_upper_cased(spark):
    df = spark.createDataFrame([(1, "a")], "` sim_round ` int, `Material_Code` string")
    assert clean_headers(df).columns == ["SIM_ROUND", "MATERIAL_CODE"]


def test_headers_must_stay_unique(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, 2)], "cost int, COST int")
        with pytest.raises(ContractError, match="COST"):
            clean_headers(df, "sales")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_unlisted_columns_are_left_out_and_listed_ones_renamed(spark):
    df = raw(spark)["sales"].withColumnRenamed("AREA", "COLOUR")
    assert conform(df, SALES).columns == [
        "round", "company", "product", "channel", "net_price", "net_sales", "cost", "quantity", "qty_delivered",
    ]


def test_missing_columns_are_named(spark):
    with pytest.raises(ContractError, match="NET_VALUE, COST"):
        tables(spark, sales=raw(spark)["sales"].drop("COST", "NET_VALUE"))


def test_one_quantity_is_needed(spark):
    with pytest.raises(ContractError, match="one of QUANTITY, QUANTITY_DELIVERED"):
        tables(spark, sales=raw(spark)["sales"].drop("QUANTITY", "QUANTITY_DELIVERED"))


def test_a_measure_must_be_a_number(spark):
    sales = raw(spark)["sales"]
    with pytest.raises(ContractError, match="sales.COST must be a number"):
        tables(spark, sales=sales.withColumn("COST", sales.COST.cast("string")))


def test_text_and_number_keys_do_not_join(spark):
    production = spark.createDataFrame([("A", 1, 7, 1.0)], "COMPANY_CODE string, SIM_ROUND int, MATERIAL_CODE int, YIELD double")
    with pytest.raises(ContractError, match="product"):
        sales_fact(tables(spark, production=production))


def test_nan_is_a_missing_value(spark):
    df = spark.createDataFrame(
        [(1, "A", float("nan")), (1, "A", 5.0)], "SIM_ROUND int, SALES_ORGANIZATION string, AMOUNT double"
    )
    spend = tables(spark, marketing=df).marketing
    assert [r.marketing_spend for r in spend.orderBy("marketing_spend").collect()] == [None, 5.0]


def test_all_five_tables_are_needed(spark):
    frames = raw(spark)
    del frames["market"]
    with pytest.raises(ValueError, match="market"):
        Tables.conform(**frames)


@pytest.mark.parametrize("file_format", ["parquet", "csv", "orc"])
def test_tables_are_read_from_files(spark, tmp_path, file_format):
    for name, df in raw(spark).items():
        df.write.option("header", True).format(file_format).save(f"{tmp_path}/{name}")
    read = read_tables(spark, str(tmp_path), file_format)
    expected = tables(spark)
    for name in raw(spark):
        ours, theirs = getattr(read, name), getattr(expected, name)
        assert ours.dtypes == theirs.dtypes
        assert sorted(ours.collect(), key=str) == sorted(theirs.collect(), key=str)


def test_tables_are_read_from_a_catalog(spark, tmp_path):
    spark.sql(f"create database planning location '{tmp_path}/planning'")
    try:
        for name, df in raw(spark).items():
            df.write.saveAsTable(f"planning.{name}")
        assert catalog_tables(spark, "planning").sales.count() == 13
    finally:
        spark.sql("drop database planning cascade")


def test_rounds_must_be_whole(spark):
    from pyspark.errors import PySparkException

    from stockloom.sources.contract import MARKETING, conform

    made = lambda rounds: conform(spark.createDataFrame([(r, "a", 1.0) for r in rounds], "SIM_ROUND double, SALES_ORGANIZATION string, AMOUNT double"), MARKETING)
    assert [r["round"] for r in made([1.0, 202401150000.0, None]).collect()] == [1, 202401150000, None]
    with pytest.raises(PySparkException, match="must be whole"):
        made([1.5]).collect()


def test_infinity_is_a_missing_value(spark):
    from stockloom.sources.contract import MARKETING, conform

    rows = spark.createDataFrame([(1, "a", float("inf"))], "SIM_ROUND int, SALES_ORGANIZATION string, AMOUNT double")
    assert conform(rows, MARKETING).first().marketing_spend is None
