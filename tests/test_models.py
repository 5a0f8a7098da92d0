"""Encoding and models on small tables with known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom import forecast, forecast_metrics, model_comparison
from stockloom.operators.encoding import NO_SLOT, encode
from stockloom.plans import forecasting, ridge
from stockloom.plans.forecasting import forecast_encoded, prepare_training
from stockloom.sources.scratch import keep

COLUMNS = "company string, product string, round int, line_no bigint, area string, cost double, net_sales double, demand double"


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    rows = []
    for company, n in (("A", 240), ("B", 120)):
        for i in range(n):
            cost, sales = float(rng.normal(10, 3)), float(rng.gamma(3, 20))
            product = "pqr"[int(rng.integers(3))]
            demand = max(0.0, 3 + 0.2 * sales - 0.5 * cost + "pqr".index(product) * 4 + float(rng.normal()))
            rows.append((company, product, 1 + i * 6 // n, i, "NS"[i % 2], cost, sales, demand))
    return keep(spark.createDataFrame(rows, COLUMNS), "features")


def company_rows(features, company):
    return features.where(F.col("company") == company).toPandas().sort_values("line_no")


def test_ridge_that_does_not_settle_is_told(features, monkeypatch):
    monkeypatch.setattr(ridge, "ROUNDS", 0)
    with pytest.raises(RuntimeError, match="settle"):
        forecast(features, "ridge")


def test_any_company_name_and_a_failing_one(features, monkeypatch):
    named = features.withColumn("company", F.when(F.col("company") == "A", "").otherwise(F.col("company")))
    assert {r.company for r in forecast(named, "ridge").lines.select("company").distinct().collect()} == {"", "B"}
    named = named.where("round > 3")
    whole = forecasting._fit_one

    def failing(lines, encoded, row, *rest):
        if row.company == "":
            raise ArithmeticError("no fit")
        whole(lines, encoded, row, *rest)

    monkeypatch.setattr(forecasting, "_fit_one", failing)
    result = forecast(named, "forest")
    assert result.failed == {"": "no fit"}
    assert {r.company for r in result.lines.select("company").distinct().collect()} == {"B"}


def test_ridge_is_the_closed_form(features):
    scored = forecast(features, "ridge").lines.toPandas()
    for company in "AB":
        pdf = company_rows(features, company)
        train, test = pdf[pdf["round"] < 6], pdf[pdf["round"] == 6]

        def matrix(part):
            parts = [((part[c] - train[c].mean()) / train[c].std(ddof=0)).to_numpy() for c in ("cost", "net_sales")]
            parts += [(part["product"] == p).to_numpy(float) for p in "qr"]
            parts += [(part["area"] == "S").to_numpy(float)]
            return np.stack(parts, axis=1)

        x, y = matrix(train), train["demand"].to_numpy()
        centred = x - x.mean(axis=0)
        weights = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y - y.mean()))
        want = np.clip(y.mean() + (matrix(test) - x.mean(axis=0)) @ weights, 0, None)
        got = scored[scored["company"] == company].sort_values("line_no")
        np.testing.assert_allclose(got["prediction"], want, atol=1e-9, rtol=0)
        assert list(got["forecast"]) == [int(v) for v in got["prediction"]]


def test_ridge_takes_the_same_jobs_for_any_number_of_companies(spark, features):
    def jobs(companies: int) -> int:
        copies = features.where("company = 'B'").crossJoin(spark.range(companies).withColumnRenamed("id", "copy"))
        encoded = prepare_training(keep(copies.withColumn("company", F.concat("company", F.col("copy"))).drop("copy"), "copies"))
        tracker, group = spark.sparkContext.statusTracker(), f"ridge {companies}"
        spark.sparkContext.setJobGroup(group, "")
        try:
            lines = forecast_encoded(encoded, "ridge").lines
            assert lines.select("company").distinct().count() == companies
            return len(tracker.getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(1) == jobs(12)


def test_ridge_of_features_that_hang_together(spark):
    """Equal columns, a number that is constant, and many categories: the penalty still decides."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=400)
    rows = [("A", f"p{i % 90}", 1 + i // 100, i, "N", float(x[i]), float(2 * x[i]), float(3 * x[i] + i % 90)) for i in range(400)]
    features = spark.createDataFrame(rows, COLUMNS)
    encoded = prepare_training(features, ("cost", "net_sales", "product", "area"))
    weights = {(r.feature, r.slot): r.weight for r in ridge.ridge_weights(encoded).collect()}
    lines = encoded.lines.where("not is_test").toPandas()
    matrix = np.stack([lines["cost_scaled"], lines["net_sales_scaled"], *[lines["product_slot"] == s for s in range(89)]], axis=1).astype(float)
    centred, y = matrix - matrix.mean(axis=0), lines["demand"].to_numpy()
    want = np.linalg.solve(centred.T @ centred + np.eye(91), centred.T @ (y - y.mean()))
    got = [weights["cost", 0], weights["net_sales", 0], *[weights["product", s] for s in range(89)]]
    np.testing.assert_allclose(got, want, atol=1e-9, rtol=0)
    assert weights[None, 0] == pytest.approx(y.mean() - matrix.mean(axis=0) @ want, abs=1e-9)


@pytest.mark.parametrize("model", ["forest", "boosting"])
def test_trees_beat_the_mean(features, model):
    one = features.where("company = 'A'")
    lines = forecast(one, model).lines
    assert lines.where("prediction < 0").isEmpty()
    mean = one.where("round < 6").agg(F.avg("demand")).first()[0]
    naive = one.where("round = 6").agg(F.avg(F.abs(F.col("demand") - mean))).first()[0]
    assert forecast_metrics(lines).first().mae < naive


def test_a_seeded_model_repeats_itself(features):
    encoded = prepare_training(features)
    first, second = (forecast_encoded(encoded, "forest").lines for _ in range(2))
    assert sorted(first.collect()) == sorted(second.collect())


def test_missing_values_are_filled_from_training_rows(spark):
    rows = [
        ("A", "p", 1, 0, "N", 1.0, 1.0, 1.0),
        ("A", "p", 1, 1, "S", 2.0, 1.0, 2.0),
        ("A", "q", 2, 2, "S", 4.0, 1.0, 3.0),
        ("A", "q", 2, 3, None, 10.0, 1.0, 4.0),
        ("A", "q", 3, 4, None, None, 1.0, 5.0),
        ("A", "new", 3, 5, "W", 4.25, 2.0, 6.0),
    ]
    encoded = encode(spark.createDataFrame(rows, COLUMNS), ("cost", "net_sales", "product", "area"))
    got = {r.line_no: r for r in encoded.lines.collect()}
    cost = np.array([1.0, 2.0, 4.0, 10.0])
    scaled = lambda v: (v - cost.mean()) / cost.std()
    assert got[0].cost_scaled == pytest.approx(scaled(1.0), abs=1e-12)
    assert got[4].cost_scaled == pytest.approx(scaled(3.0), abs=1e-12)  # the median of four values
    # net_sales is constant in training: centred, not divided.
    assert [got[i].net_sales_scaled for i in (0, 4, 5)] == [0.0, 0.0, 1.0]
    # First category and unseen ones have no slot; a missing area becomes S.
    assert [got[i].product_slot for i in (0, 2, 5)] == [NO_SLOT, 0, NO_SLOT]
    assert [got[i].area_slot for i in (0, 1, 3, 4, 5)] == [NO_SLOT, 0, 0, 0, NO_SLOT]
    assert [got[i].is_test for i in range(6)] == [False] * 4 + [True] * 2


def test_a_numeric_product_is_a_number(spark, features):
    numbered = features.withColumn("product", F.ascii("product"))
    encoded = encode(numbered)
    assert encoded.numbers == ["cost", "product", "net_sales"] and encoded.texts == ["area"]


def test_a_single_category_is_no_feature(spark, features):
    same = features.withColumn("product", F.lit("p")).withColumn("area", F.lit("N"))
    assert forecast(same, "ridge").lines.count() == 60


def test_a_constant_target_is_predicted(features):
    constant = features.withColumn("demand", F.lit(7.0))
    metrics = forecast_metrics(forecast(constant, "ridge").lines)
    assert [(r.mae, r.r2) for r in metrics.collect()] == [(0.0, 1.0)] * 2


def test_companies_with_one_round_are_skipped(features):
    cut = features.where("company = 'A' or round = 6")
    result = forecast(cut, "ridge")
    assert result.skipped == ["B"]
    assert {r.company for r in result.lines.select("company").distinct().collect()} == {"A"}
    with pytest.raises(ValueError, match="company B"):
        forecast(cut, "ridge", company="B")
    with pytest.raises(ValueError, match="company C"):
        forecast(features, "ridge", company="C")


def test_unknown_models_are_refused(features):
    with pytest.raises(ValueError, match="ridge, forest, boosting"):
        forecast(features, "linear")


def test_model_comparison_has_a_row_per_company_and_model(features):
    rows = model_comparison(features, ("ridge", "forest")).collect()
    assert [(r.company, r.model) for r in rows] == [("A", "forest"), ("A", "ridge"), ("B", "forest"), ("B", "ridge")]
    assert all(r.mae > 0 and r.r2 <= 1 for r in rows)


def test_a_large_company_is_laid_out_in_several_files(spark, features):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16KB")
    try:
        copies = features.crossJoin(spark.range(200).withColumnRenamed("id", "copy")).repartition(8)
        grown = copies.withColumn("line_no", F.monotonically_increasing_id()).withColumn("cost", F.col("cost") + F.rand(1))
        lines = prepare_training(keep(grown.drop("copy"), "grown")).lines
        folder = lines.where("company = 'A'").first().company_folder
        files = [f for f in lines.inputFiles() if f"company_folder={folder}" in f]
        assert len(files) > 1 and lines.count() == 72_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
