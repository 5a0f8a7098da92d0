"""CSV files whose cells are not what their columns hold."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from checks import queries, star
from stockloom import ContractError
from stockloom.sources.rejects import read_csv_tables, screen
from stockloom.sources.contract import MARKETING, SALES
from stockloom.sources.scratch import keep

from . import tables

HEADER = " sim_round ,SALES_ORGANIZATION,AMOUNT,bad,row"
LINES = ["1,A,100.5,x,y", "2,A,n/a,x,y", "2.5,B,12;5,,y", " 3 ,B,   ,x,y", ",B,,x,y", "2,A,n/a,x,y", "1e300,C,1,x,y", "x,C,NaN,x,y", "NaN,007,1e2,x,y"]


@pytest.fixture
def folder(spark, tmp_path):
    for name, df in tables.raw(spark).items():
        df.write.option("header", True).csv(f"{tmp_path}/{name}")
    return str(tmp_path)


def _marketing(spark, tmp_path, lines):
    path = tmp_path / "spend.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return spark.read.option("header", True).csv(str(path))


def test_bad_cells_are_listed_with_their_rows(spark, tmp_path):
    rows, rejects = screen(_marketing(spark, tmp_path, LINES), MARKETING)
    assert sorted((r.field, r.cell, r.reason) for r in rejects.collect()) == [
        ("AMOUNT", "12;5", "not a number"),
        ("AMOUNT", "n/a", "not a number"),
        ("AMOUNT", "n/a", "not a number"),
        ("SIM_ROUND", "1e300", "not a whole number"),
        ("SIM_ROUND", "2.5", "not a whole number"),
        ("SIM_ROUND", "x", "not a number"),
    ]
    first = rejects.where("cell = '2.5'").first()
    assert first.table_name == "marketing" and json.loads(first.row_text) == {
        "SIM_ROUND": "2.5", "SALES_ORGANIZATION": "B", "AMOUNT": "12;5", "ROW": "y"
    }
    kept = sorted(((str(r.SIM_ROUND), r.SALES_ORGANIZATION, r.AMOUNT) for r in rows.collect()), key=str)
    assert kept == sorted([("1.0", "A", 100.5), ("3.0", "B", None), ("None", "B", None), ("nan", "007", 100.0)], key=str)


def test_an_empty_table_has_no_rejects(spark, tmp_path):
    rows, rejects = screen(_marketing(spark, tmp_path, []), MARKETING)
    assert rows.count() == rejects.count() == 0


def test_nothing_is_shuffled(spark):
    for df in screen(tables.raw(spark)["sales"].selectExpr(*[f"cast({c} as string) {c}" for c in tables.raw(spark)["sales"].columns]), SALES):
        assert "Exchange" not in df._jdf.queryExecution().toString()


def test_clean_files_load_as_before(spark, folder):
    loaded = read_csv_tables(spark, folder, most=0)
    want = tables.tables(spark)
    for name in ("sales", "production", "inventory", "market", "marketing"):
        assert sorted(map(str, getattr(loaded.tables, name).collect())) == sorted(map(str, getattr(want, name).collect()))
    assert loaded.rejects.count() == 0


def test_more_bad_cells_than_allowed_are_an_error(spark, folder, tmp_path):
    (tmp_path / "marketing" / "more.csv").write_text("SIM_ROUND,SALES_ORGANIZATION,AMOUNT\n1,A,none\n2,B,5 EUR\n")
    with pytest.raises(ContractError, match=r"more than 1 bad cells \(marketing.AMOUNT: 2\)"):
        read_csv_tables(spark, folder, most=1)
    loaded = read_csv_tables(spark, folder, most=2)
    assert loaded.rejects.count() == 2 and loaded.tables.marketing.count() == len(tables.MARKETING_ROWS)


def test_the_query_s_csv_files_are_compressed_and_lines_joined_once(spark, small_dir, monkeypatch):
    """What the CSV queries put on disk: files of a bounded number of rows, and the lines are moved for one join."""
    seen = {}

    def read(spark, root):
        paths = {name: spark.read.option("header", True).csv(f"{root}/{name}") for name in ("sales", "inventory")}
        for name, df in paths.items():
            rows = [row["count"] for row in df.groupBy(F.input_file_name().alias("file")).count().collect()]
            seen[name] = (df.inputFiles(), rows)
        return read_csv_tables(spark, root)

    joined = []
    monkeypatch.setattr(star, "keep", lambda df, name: joined.append(name) or keep(df, name))
    monkeypatch.setattr(queries, "read_csv_tables", read)
    monkeypatch.setattr(queries, "_CSV_ROWS", 500)
    loaded = queries._from_csv(spark, small_dir)
    assert "joined_lines" in joined
    for files, rows in seen.values():
        assert all(file.endswith(".csv.gz") for file in files) and len(files) > 1 and max(rows) <= 500
    want = star.star_tables(spark, small_dir).inventory
    assert sorted(map(str, loaded.tables.inventory.collect())) == sorted(map(str, want.collect()))
