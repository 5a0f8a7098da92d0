"""Fitted trees as a table: the same predictions, by joins and by a walk in SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.plans import forecasting
from stockloom.plans.forecasting import Ledger, forecast_encoded, prepare_training
from stockloom.plans.trees import fitted_trees, score_trees
from stockloom.sources.scratch import keep, new_path
from stockloom.sources.store import Store

from .test_models import COLUMNS

WALK = """
with recursive walk as (
    select l.line_no, l.company, n.tree, n.weight, 0 as node
    from lines l join nodes n on n.company = l.company and n.node = 0
    union all
    select w.line_no, w.company, w.tree, w.weight,
        case when case when n.threshold is not null then x.x <= n.threshold else list_contains(n.left_values, x.x) end
            then n."left" else n."right" end
    from walk w
    join nodes n on n.company = w.company and n.tree = w.tree and n.node = w.node and n.feature is not null
    join (
        select line_no, feature, slot, x from numbers
        union all
        select c.line_no, c.feature, s.slot, (c.slot = s.slot)::double from texts c, (select distinct feature, slot from nodes where slot is not null) s
        where s.feature = c.feature
    ) x on x.line_no = w.line_no and x.feature = n.feature and x.slot is not distinct from n.slot
)
select w.line_no, sum(n.value * w.weight) as total, sum(w.weight) as weights
from walk w join nodes n on n.company = w.company and n.tree = w.tree and n.node = w.node and n.feature is null
group by w.line_no
"""


def walked(encoded, nodes, lines):
    """Line number to the sum of the leaves and of the weights, by DuckDB."""
    db = duckdb.connect()
    db.register("lines", lines.select("line_no", "company").toPandas())
    table = nodes.toPandas()
    table["slot"] = table["slot"].astype("Int64")
    db.register("nodes", table)
    numbers = [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("int").alias("slot"), F.col(f"{c}_scaled").alias("x")) for c in encoded.numbers]
    texts = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_slot").alias("slot")) for c in encoded.texts]
    numbers = lines.select("line_no", F.inline(F.array(*numbers))).toPandas()
    numbers["slot"] = numbers["slot"].astype("Int64")
    db.register("numbers", numbers)
    db.register("texts", lines.select("line_no", F.inline(F.array(*texts))).toPandas())
    return {line: (total, weights) for line, total, weights in db.execute(WALK).fetchall()}


@pytest.fixture(scope="module")
def features(spark):
    """Two companies, one with a category more; demand that depends on numbers and texts."""
    draw = np.random.default_rng(11)
    rows = []
    for company, n in (("A", 300), ("B'\"", 150)):
        for i in range(n):
            cost, sales = float(draw.normal(10, 3)), float(draw.gamma(3, 20))
            product = ("pqrs" if company == "A" else "pq")[i % (4 if company == "A" else 2)]
            demand = max(0.0, 3 + 0.2 * sales - 0.5 * cost + "pqrs".index(product) * 6 + 5 * (i % 3 == 0) + float(draw.normal()))
            rows.append((company, product, 1 + i * 6 // n, len(rows), "NSW"[i % 3], cost, sales, demand))
    # A product that training has not seen.
    rows.append(("A", "new", 6, len(rows), "N", 10.0, 60.0, 12.0))
    return keep(spark.createDataFrame(rows, COLUMNS), "features")


@pytest.fixture(scope="module")
def encoded(features):
    return prepare_training(features)


@pytest.fixture(scope="module", params=["forest", "boosting"])
def fitted(request, encoded):
    return request.param, fitted_trees(encoded, request.param)


def test_trees_say_what_the_model_said(encoded, fitted):
    model, trees = fitted
    scored = score_trees(encoded.lines.where("is_test"), encoded, trees.nodes)
    pairs = trees.forecast.lines.alias("f").join(scored.alias("s"), "line_no").select(
        "line_no", F.col("f.prediction").alias("want"), F.greatest("s.prediction", F.lit(0.0)).alias("got"), "s.model"
    ).collect()
    assert len(pairs) == trees.forecast.lines.count() == encoded.lines.where("is_test").count()
    assert {r.model for r in pairs} == {model}
    for row in pairs:
        assert row.got == pytest.approx(row.want, abs=1e-9)


def test_trees_walked_in_sql(encoded, fitted):
    model, trees = fitted
    lines = encoded.lines
    sums = walked(encoded, trees.nodes, lines)
    scored = score_trees(lines, encoded, trees.nodes).collect()
    assert len(scored) == lines.count() == len(sums)
    for row in scored:
        total, weights = sums[row.line_no]
        assert row.prediction == pytest.approx(total / weights if model == "forest" else total, abs=1e-9)


def test_boosting_starts_at_means_of_the_training_lines(features, fitted):
    model, trees = fitted
    if model != "boosting":
        pytest.skip("a forest draws its lines")
    nodes = trees.nodes.where("tree = 0 and node = 0").collect()
    means = features.where("round < 6").groupBy("company").agg(F.avg("demand").alias("mean"), F.count("*").alias("n")).collect()
    want = {r.company: (r.n, pytest.approx(r.mean)) for r in means}
    assert {r.company: (r.training_lines, r.value) for r in nodes} == want


def test_nodes_form_trees(fitted):
    model, trees = fitted
    nodes = trees.nodes
    assert nodes.select("company", "tree").distinct().count() == 2 * {"forest": 100, "boosting": 200}[model]
    children = nodes.select("company", "tree", F.explode(F.array("left", "right")).alias("node")).where("node is not null")
    others = nodes.where("node > 0").select("company", "tree", "node")
    assert children.exceptAll(others).isEmpty() and others.exceptAll(children).isEmpty()
    inner = "feature is not null and left is not null and right is not null and (threshold is null) = (left_values is not null)"
    leaf = "coalesce(feature, slot, threshold, left_values[0], left, right) is null and feature is null"
    assert nodes.where(f"not ({inner}) and not ({leaf})").isEmpty()


def test_numbers_alone_and_a_tree_that_is_a_leaf(spark):
    """One constant feature: each tree is its root."""
    rows = [("A", "p", 1 + i // 20, i, "N", 4.0, 1.0, float(i)) for i in range(60)]
    encoded = prepare_training(spark.createDataFrame(rows, COLUMNS), ("cost",))
    trees = fitted_trees(encoded, "forest")
    roots = [r.value for r in trees.nodes.collect()]
    assert len(roots) == 100 and trees.nodes.where("feature is not null").isEmpty()
    scored = score_trees(encoded.lines, encoded, trees.nodes).collect()
    assert len(scored) == 60 and all(r.prediction == pytest.approx(np.mean(roots)) for r in scored)


def test_a_ledger_keeps_trees_with_their_lines(spark, encoded, monkeypatch):
    ledger = Ledger(Store(spark, "unused"), new_path(spark, "ledger"))
    first = fitted_trees(encoded, "forest", ledger=ledger)
    before = sorted(map(str, first.nodes.collect()))
    monkeypatch.setattr(forecasting, "_fit_one", None)
    again = fitted_trees(encoded, "forest", ledger=ledger)
    assert sorted(map(str, again.nodes.collect())) == before
    assert again.forecast.lines.count() == first.forecast.lines.count()


def test_a_ledger_without_trees_is_told(spark, encoded):
    ledger = Ledger(Store(spark, "unused"), new_path(spark, "ledger"))
    forecast_encoded(encoded, "forest", ledger=ledger)
    with pytest.raises(ValueError, match="not kept"):
        fitted_trees(encoded, "forest", ledger=ledger)


def test_lines_of_companies_without_trees_and_no_lines(encoded, fitted):
    _, trees = fitted
    assert score_trees(encoded.lines.where("false"), encoded, trees.nodes).isEmpty()
    only = score_trees(encoded.lines, encoded, trees.nodes.where("company = 'A'"))
    assert {r.company for r in only.select("company").distinct().collect()} == {"A"}


def test_ridge_has_no_trees(encoded):
    with pytest.raises(ValueError, match="no trees"):
        fitted_trees(encoded, "ridge")
