"""Tables and fits that outlast a session."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor as plain_pool

import pytest
from pyspark.sql import functions as F

from checks.star import star_tables
from stockloom import Workbench, read_tables
from stockloom.plans import forecasting, workbench
from stockloom.sources.contract import CONTRACTS

class Cut(BaseException):
    """Stands for the end of the driver."""


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """The five tables of the smallest data, under the names a user's tables have."""
    folder = str(tmp_path_factory.mktemp("tables"))
    tables = star_tables(spark, SMALL)
    for name, contract in CONTRACTS.items():
        df = getattr(tables, name)
        df.select(*[F.col(f.name).alias(f.source) for f in contract.fields if f.name in df.columns]).write.parquet(f"{folder}/{name}")
    return folder


def _rows(df):
    return sorted(map(str, df.collect()))


def test_a_second_session_finds_the_tables(spark, root, tmp_path, monkeypatch):
    first = Workbench(read_tables(spark, root), store=str(tmp_path))
    features, rounds = _rows(first.features), _rows(first.rounds)
    assert features == _rows(Workbench(read_tables(spark, root)).features)

    def fail(*_):
        raise AssertionError("built again")

    monkeypatch.setattr(workbench, "demand_features", fail)
    monkeypatch.setattr(workbench, "product_rounds", fail)
    other = spark.newSession()
    second = Workbench(read_tables(other, root), store=str(tmp_path))
    assert _rows(second.features) == features and _rows(second.rounds) == rounds
    with pytest.raises(AssertionError, match="built again"):
        Workbench(read_tables(spark, root), company="EUROPE", store=str(tmp_path)).features


def test_a_second_session_reads_no_line(spark, root, tmp_path):
    Workbench(read_tables(spark, root), store=str(tmp_path)).features
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("found again", "")
    try:
        features = Workbench(read_tables(spark, root), store=str(tmp_path)).features
        # For each table a look into a footer and a listing of files in two stages; no job besides.
        assert len(tracker.getJobIdsForGroup("found again")) <= 3 * len(CONTRACTS)
        assert all(str(tmp_path) in file for file in features.inputFiles())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_changed_input_is_built_again(spark, root, tmp_path, monkeypatch):
    tables = read_tables(spark, root)
    copy = str(tmp_path / "tables")
    for name in CONTRACTS:
        spark.read.parquet(f"{root}/{name}").write.parquet(f"{copy}/{name}")
    store, built = str(tmp_path / "store"), []
    plain = workbench.demand_features
    monkeypatch.setattr(workbench, "demand_features", lambda *a: built.append(1) or plain(*a))
    Workbench(read_tables(spark, copy), store=store).features
    Workbench(read_tables(spark, copy), store=store).features
    assert len(built) == 1
    # The same rows in a file of another time.
    file = next(f for f in os.listdir(f"{copy}/marketing") if f.endswith(".parquet"))
    os.utime(f"{copy}/marketing/{file}", (1, 1))
    Workbench(read_tables(spark, copy), store=store).features
    assert len(built) == 2
    spark.read.parquet(f"{root}/sales").limit(50).write.mode("append").parquet(f"{copy}/sales")
    grown = Workbench(read_tables(spark, copy), store=store).features
    assert len(built) == 3 and grown.agg(F.sum("demand")).first() != plain_total(spark, tables)


def plain_total(spark, tables):
    return Workbench(tables).features.agg(F.sum("demand")).first()


def test_half_written_tables_are_built_again(spark, root, tmp_path):
    features = _rows(Workbench(read_tables(spark, root), store=str(tmp_path)).features)
    folder = next(p for p in tmp_path.iterdir() if p.name.startswith("features-"))
    (folder / "_stockloom.json").unlink()
    spark.read.parquet(str(folder)).limit(3).write.mode("append").parquet(str(folder))
    assert _rows(Workbench(read_tables(spark, root), store=str(tmp_path)).features) == features


def test_tables_without_files_are_not_stored(spark, root, tmp_path):
    tables = read_tables(spark, root)
    in_memory = spark.createDataFrame(tables.marketing.toPandas(), tables.marketing.schema)
    bench = Workbench(type(tables)(**{**vars(tables), "marketing": in_memory}), store=str(tmp_path))
    assert bench.features.count() > 0 and not any(p.name.startswith("features-") for p in tmp_path.iterdir())


def test_a_rerun_fits_what_is_missing(spark, root, tmp_path, monkeypatch):
    """The first run is cut off after two fits, the second ends but for one, the third ends."""
    fitted, plain = [], forecasting._fit_one

    def fit(limit, broken=()):
        def one(lines, encoded, row, *rest):
            if len(fitted) >= limit:
                raise Cut
            if row.company in broken:
                raise ArithmeticError("no fit")
            plain(lines, encoded, row, *rest)
            fitted.append(row.company)

        return one

    bench = lambda: Workbench(read_tables(spark, root), store=str(tmp_path))
    monkeypatch.setattr(forecasting, "ThreadPoolExecutor", lambda max_workers: plain_pool(max_workers=1))
    monkeypatch.setattr(forecasting, "_fit_one", fit(2))
    with pytest.raises(Cut):
        bench().forecast("forest")
    assert len(fitted) == 2
    companies = {r.company for r in bench().companies().collect()}
    last = max(companies - set(fitted))
    monkeypatch.setattr(forecasting, "_fit_one", fit(99, {last}))
    second = bench()
    assert second.forecast("forest").failed == {last: "no fit"} and set(fitted) == companies - {last} and len(fitted) == len(companies) - 1
    with pytest.raises(RuntimeError, match=f"{last}: no fit"):
        second.metrics("forest")
    monkeypatch.setattr(forecasting, "_fit_one", fit(99))
    third = bench()
    assert {r.company for r in third.metrics("forest").collect()} == companies and len(fitted) == len(companies)
    monkeypatch.setattr(forecasting, "_fit_one", fit(0))
    assert _rows(bench().forecast("forest").lines) == _rows(third.forecast("forest").lines)
