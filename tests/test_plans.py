"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stockloom import (
    Tables,
    demand_features,
    planning_indicators,
    product_forecast,
    product_rounds,
    profile_numeric,
    release,
    sales_fact,
    sales_lines,
)
from stockloom.operators.encoding import encode
from stockloom.sources import scratch
from stockloom.sources.scratch import keep

from .tables import raw


def plan(df) -> str:
    spark = df.sparkSession
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark):
    return Tables.conform(**{name: keep(df, name) for name, df in raw(spark).items()})


@pytest.fixture(scope="module")
def features(stored):
    return demand_features(sales_fact(stored))


def test_a_company_is_filtered_in_the_scan(stored):
    fact = sales_fact(stored).where(F.col("company") == "A")
    assert "EqualTo(SALES_ORGANIZATION,A)" in plan(fact)


def test_a_company_is_filtered_below_the_windows(features):
    # Once at the lines, once at the slice totals.
    assert plan(features.where(F.col("company") == "A")).count("EqualTo(company,A)") == 2


def test_small_sides_are_broadcast_by_their_measured_size(spark, stored):
    text = plan(sales_fact(stored))
    assert text.count("BroadcastHashJoin LeftOuter BuildRight") == 4 and "SortMergeJoin" not in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = sales_fact(stored)
        text = plan(fact)
        assert "Broadcast" not in text and "SortMergeJoin" in text
        shuffled = sorted(demand_features(fact).drop("line_no").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled == sorted(demand_features(sales_fact(stored)).drop("line_no").collect())


def test_lines_are_windowed_within_slices_only(features):
    text = plan(features)
    lines = [e for e in re.findall(r"hashpartitioning\(([^)]*)\)", text) if "slice" in e]
    assert lines and all(re.sub(r"#\d+L?", "", e).startswith("company, product, slice") for e in lines)
    # The one window without the slice runs over the slice totals.
    frames = re.findall(r"\], \[(company#\d+, product#\d+[^\]]*)\], \[", text)
    assert any("slice" in f for f in frames)
    assert "line_no" not in [f for f in frames if "slice" not in f][0]


def test_partial_sums_come_before_the_shuffle(stored):
    text = plan(sales_lines(stored.sales))
    assert "partial_sum" in text and text.count("Arguments: hashpartitioning") == 1


def test_scans_read_the_needed_columns_only(features):
    kept = keep(features, "features")
    text = plan(kept.groupBy("company", "product", "round").agg(F.sum("demand")))
    assert "ReadSchema: struct<round:bigint,product:string,company:string,demand:double>" in text


def test_no_python_and_no_cross_joins(features):
    kept = keep(features, "features")
    rounds = product_rounds(kept)
    forecast = product_forecast(kept.withColumn("forecast", F.col("demand_lag1").cast("bigint")))
    for df in (features, rounds, planning_indicators(rounds, forecast), profile_numeric(kept), encode(kept).lines):
        text = plan(df)
        assert not re.search(r"Python|Pandas|CartesianProduct|NestedLoop", text)


class FakeSession:
    """A session on a cluster, with or without the setting."""

    def __init__(self, folder):
        self.sparkContext = SimpleNamespace(master="yarn", applicationId="a", getCheckpointDir=lambda: None)
        self.conf = SimpleNamespace(get=lambda name, default: {"spark.checkpoint.dir": folder}.get(name) or default)


def test_intermediate_tables_go_to_the_named_folder(spark):
    assert scratch.shared_folder(FakeSession("hdfs:///shared/")) == "hdfs:///shared"
    assert keep(spark.range(3), "three").inputFiles()[0].startswith(f"file://{scratch.shared_folder(spark)}/three-")


def test_release_deletes_what_was_written_and_nothing_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "_written", {})
    (tmp_path / "other").mkdir()
    monkeypatch.setattr(scratch, "shared_folder", lambda session: str(tmp_path))
    keep(spark.range(3), "three")
    assert len(list(tmp_path.iterdir())) == 2
    release(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(FakeSession(None))


def test_a_workbench_leaves_no_table_behind(spark, tmp_path, monkeypatch, small_dir):
    from checks.star import star_tables
    from stockloom import Workbench

    monkeypatch.setattr(scratch, "_written", {})
    monkeypatch.setattr(scratch, "shared_folder", lambda session: str(tmp_path))
    with Workbench(star_tables(spark, small_dir)) as bench:
        assert bench.overview().count() == 5
        assert list(tmp_path.iterdir())
    assert not list(tmp_path.iterdir())


def test_one_company_cuts_every_table_that_names_it(spark, small_dir):
    from checks.star import star_tables
    from stockloom import sales_fact

    tables = star_tables(spark, small_dir)
    alone = sales_fact(tables, "ASIA")
    every = sales_fact(tables).where("company = 'ASIA'")
    assert sorted(alone.collect(), key=str) == sorted(every.collect(), key=str)
    written = [f for f in alone.inputFiles() if "/production-" in f or "/marketing-" in f]
    sides = [spark.read.parquet(f) for f in written]
    assert sides and all({r.company for r in side.select("company").distinct().collect()} <= {"ASIA"} for side in sides)
