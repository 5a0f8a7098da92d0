"""Trees grown from sums per node and bin: what Spark's own estimators make of the same lines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from stockloom.operators import binned_trees
from stockloom.operators.binned_trees import Settings, boost_trees, draws, find_bins, fit_trees, predict_trees, thresholds
from stockloom.sources.scratch import keep, shared_folder

NUMBERS, TEXTS, SLOTS = ["cost", "sales"], ["product", "area"], [3, 1]


@pytest.fixture(scope="module")
def lines(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(900):
        cost, sales, product, area = float(draw.normal()), float(draw.gamma(2)), int(draw.integers(-1, 3)), int(draw.integers(-1, 1))
        demand = 2 * sales - cost * (product == 1) + 3 * (area == 0) + float(draw.normal() / 5)
        rows.append((i, cost, sales, product, area, demand))
    schema = "line_no bigint, cost_scaled double, sales_scaled double, product_slot int, area_slot int, demand double"
    return keep(spark.createDataFrame(rows, schema).repartition(3, "line_no"), "binned_lines")


def _vectors(lines):
    for c, k in zip(TEXTS, SLOTS):
        about = {"ml_attr": {"type": "nominal", "name": f"{c}_slot", "num_vals": k + 1}}
        place = F.when(F.col(f"{c}_slot") < 0, k).otherwise(F.col(f"{c}_slot")).cast("double")
        lines = lines.withColumn(f"{c}_slot", place.alias(f"{c}_slot", metadata=about))
    hot = [f"{c}_hot" for c in TEXTS]
    lines = OneHotEncoder(inputCols=[f"{c}_slot" for c in TEXTS], outputCols=hot).fit(lines).transform(lines)
    return VectorAssembler(inputCols=[f"{c}_scaled" for c in NUMBERS] + hot, outputCol="features").transform(lines)


def test_each_tree_of_a_forest_is_sparks_on_its_drawn_lines(spark, lines, monkeypatch):
    # Room for one tree at a time, then for both: with and without a shuffle of the sums.
    settings = Settings(trees=2, depth=4, least=5)
    bins = find_bins(lines, 900, NUMBERS, TEXTS, SLOTS, 42)
    together = fit_trees(lines, bins, settings)
    monkeypatch.setattr(binned_trees, "_SUMS_BYTES", 1)
    often = binned_trees._poisson()[draws(np.arange(900), 0, settings.seed)]
    for number, (tree, alone) in enumerate(zip(together, fit_trees(lines, bins, settings))):
        np.testing.assert_array_equal(tree.feature, alone.feature)
        np.testing.assert_array_equal(tree.cut, alone.cut)
        np.testing.assert_allclose(tree.total, alone.total)
        drawn = spark.createDataFrame([(i, int(often[i, number])) for i in range(900)], "line_no bigint, often int")
        copies = _vectors(lines.join(drawn, "line_no").withColumn("copy", F.explode(F.sequence(F.lit(0), "often"))).where("copy > 0"))
        assert tree.n[0] == copies.count()
        # Candidates for thresholds come from all lines, so only what the tree says of its nodes is held.
        got = predict_trees(copies.select(lines.columns), bins, [tree])
        means = got.groupBy("prediction").agg(F.avg("demand").alias("mean"), F.count("*").alias("n")).collect()
        assert all(row.prediction == pytest.approx(row.mean) and row.n >= 5 for row in means) and len(means) > 4
        spark_s = DecisionTreeRegressor(labelCol="demand", maxDepth=4, minInstancesPerNode=5, maxBins=128, seed=42).fit(copies).transform(copies)
        ours, theirs = (df.agg(F.avg((F.col("demand") - F.col("prediction")) ** 2)).first()[0] for df in (got, spark_s))
        assert ours == pytest.approx(theirs, rel=0.1)


def test_a_level_of_all_trees_is_one_pass(spark, lines, monkeypatch):
    """What a fit costs is passes over the lines; it does not depend on the number of trees."""
    bins = find_bins(lines, 900, NUMBERS, TEXTS, SLOTS, 42)
    passes = []
    sums = binned_trees._sums
    monkeypatch.setattr(binned_trees, "_sums", lambda *about: passes.append(len(about[1])) or sums(*about))
    fit_trees(lines, bins, Settings(trees=40, depth=3, least=5))
    assert passes == [40, 40, 40]


def test_draws_are_poisson():
    often = binned_trees._poisson()[draws(np.arange(200_000) << 20, 7, 42)]
    for k, share in enumerate((0.36788, 0.36788, 0.18394, 0.06131, 0.01533)):
        assert np.allclose((often == k).mean(axis=0), share, atol=0.005)
    assert abs(np.corrcoef(often.T) - np.eye(4)).max() < 0.01
    assert abs(np.corrcoef(often[:, 0], binned_trees._poisson()[draws(np.arange(200_000) << 20, 8, 42)][:, 0])[0, 1]) < 0.01


def test_thresholds():
    assert thresholds(np.array([2.0, 2.0, 2.0]), 5).tolist() == []
    assert thresholds(np.array([1.0, 4.0, 2.0, 4.0]), 5).tolist() == [1.5, 3.0]
    assert thresholds(np.arange(8.0), 3).tolist() == [1.5, 3.5, 5.5]


def test_missing_and_infinite_values_end_the_fit(lines):
    bins = find_bins(lines, 900, NUMBERS, TEXTS, SLOTS, 42)
    settings = Settings(trees=1, depth=1, least=1)
    for column, value in (("cost_scaled", "null"), ("demand", "double('infinity')")):
        with pytest.raises(Exception, match="missing values|not finite"):
            fit_trees(lines.withColumn(column, F.expr(f"if(line_no = 7, {value}, {column})")), bins, settings)


def test_blocks_are_deleted_when_the_fit_ends(spark, lines):
    def folders():
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tree_blocks-*")
        return len(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))

    bins = find_bins(lines, 900, NUMBERS, TEXTS, SLOTS, 42)
    before = folders()
    fit_trees(lines, bins, Settings(trees=2, depth=1, least=1))
    assert folders() == before


def test_blocks_are_dealt_to_the_cores(spark, lines, monkeypatch):
    """A company's blocks are one file's worth at first, which one task would read in every pass."""
    bins = find_bins(lines, 900, NUMBERS, TEXTS, SLOTS, 42)
    settings = Settings(trees=3, depth=3, least=1)
    whole = fit_trees(lines, bins, settings)
    monkeypatch.setattr(binned_trees, "_BLOCK_LINES", 30)
    monkeypatch.setattr(binned_trees, "discard", lambda blocks: files.append(len(blocks.inputFiles())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    files: list = []
    try:
        dealt = fit_trees(lines, bins, settings, 900)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert files == [min(15, spark.sparkContext.defaultParallelism)]
    for one, other in zip(whole, dealt):
        np.testing.assert_array_equal(one.feature, other.feature)
        np.testing.assert_allclose(one.total, other.total, atol=1e-9)


def _spark_s_boosting(lines, trees):
    vectors = _vectors(lines)
    model = GBTRegressor(labelCol="demand", maxIter=trees, stepSize=0.05, maxDepth=3, maxBins=128, seed=42).fit(vectors)
    return _by_line(model.transform(vectors))


def _by_line(scored):
    return [row.prediction for row in scored.select("line_no", "prediction").orderBy("line_no").collect()]


BOOSTING = Settings(trees=20, depth=3, least=1, rate=0.05)


def test_boosting_is_sparks(spark, lines):
    """Few lines and lines in whole numbers, whose splits often divide them alike: the same one is taken."""
    few = lines.where("line_no < 60").selectExpr("line_no", "round(cost_scaled) cost_scaled", "round(sales_scaled) sales_scaled", "product_slot", "area_slot", "round(demand, 1) demand")
    for some, n in ((lines, 900), (few, 60)):
        some = keep(some.coalesce(1), "one_file")
        bins = find_bins(some, n, NUMBERS, TEXTS, SLOTS, 42)
        got = _by_line(predict_trees(some, bins, boost_trees(some, bins, BOOSTING, n), BOOSTING))
        np.testing.assert_allclose(got, _spark_s_boosting(some, 20), atol=1e-9, rtol=0)


def test_boosting_in_jobs_is_boosting_in_one_task(spark, lines, monkeypatch):
    bins = find_bins(lines, 900, NUMBERS, TEXTS, SLOTS, 42)
    alone = boost_trees(lines, bins, BOOSTING, 900)
    for name, value in (("_ALONE_LINES", 0), ("_BLOCK_LINES", 30), ("_ROUNDS_AHEAD", 3), ("_ROUNDS_KEPT", 6)):
        monkeypatch.setattr(binned_trees, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        dealt = boost_trees(lines, bins, BOOSTING, 900)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0
    got, want = (_by_line(predict_trees(lines, bins, trees, BOOSTING)) for trees in (dealt, alone))
    np.testing.assert_allclose(got, want, atol=1e-9, rtol=0)


def test_small_companies_are_boosted_in_one_job(spark, lines):
    """Jobs do not grow with the rounds."""
    bins = find_bins(lines, 900, NUMBERS, TEXTS, SLOTS, 42)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("boosting", "")
    try:
        boost_trees(lines, bins, BOOSTING, 900)
        assert len(tracker.getJobIdsForGroup("boosting")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_boosting_of_a_constant(spark, lines):
    same = lines.withColumn("demand", F.lit(7.0))
    bins = find_bins(same, 900, NUMBERS, TEXTS, SLOTS, 42)
    trees = boost_trees(same, bins, BOOSTING, 900)
    assert len(trees) == 20 and all(tree.feature[0] < 0 for tree in trees)
    assert set(_by_line(predict_trees(same, bins, trees, BOOSTING))) == {7.0}
