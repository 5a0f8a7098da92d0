"""Fitted forests and boosted trees as a table, and predictions from that table.

A forecast keeps predictions only. With the trees of all companies in one table, lines
can be scored again without a fit, for all companies in one job and by built-in
expressions, and what a model decides on can be read and queried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..operators.binned_trees import Bins, Tree
from ..operators.encoding import Encoded
from ..sources.scratch import keep, new_path
from .forecasting import FittedModel, Forecast, Ledger, fit_name, forecast_encoded

#: How the trees of a model make one prediction: the weighted mean or the weighted sum.
COMBINED = {"forest": "mean", "boosting": "sum"}

_NO_TREES = "the ledger has fits whose trees were not kept; use another ledger"
_NODES = (
    "company string, model string, max_depth int, tree int, weight double, node int, training_lines bigint, value double, "
    "feature string, slot int, threshold double, left_values array<double>, left int, right int"
)


@dataclass(frozen=True)
class FittedTrees:
    """A forecast and the trees it was made with.

    ``nodes`` has one row per company, tree and node; node 0 is the root. ``value`` is the
    node's prediction, ``training_lines`` how many (drawn) training lines reached it. An inner
    node looks at ``feature``: the scaled number if ``slot`` is null, else 1.0 where
    the text has that slot and 0.0 where it has not. A line goes to ``left`` if that is at most
    ``threshold`` or, where ``threshold`` is null, one of ``left_values``; else to ``right``.
    Leaves have null in these columns.
    """

    forecast: Forecast
    nodes: DataFrame


def fitted_trees(
    encoded: Encoded, model: str, company: str | None = None, parallelism: int = 8, ledger: Ledger | None = None
) -> FittedTrees:
    """Fit like ``forecast_encoded`` and keep the trees as well.

    A company's trees are written before its lines, so a fit that the ``ledger`` knows has
    both. A ledger with fits whose trees were not kept is an error.
    """
    if model not in COMBINED:
        raise ValueError(f"{model!r} has no trees; choose one of {', '.join(COMBINED)}")
    spark = encoded.lines.sparkSession
    path = f"{ledger.folder}/_trees" if ledger else new_path(spark, "tree_nodes")

    def write(row: Row, fitted: FittedModel, lines: DataFrame) -> None:
        own = _nodes(spark, row.company, model, fitted)
        own.write.mode("overwrite").parquet(f"{path}/fit={fit_name(row.company)}")

    result = forecast_encoded(encoded, model, company, parallelism, write, ledger)
    if ledger and not ledger.store.exists(path):
        raise ValueError(_NO_TREES)
    nodes = spark.read.schema(f"{_NODES}, fit string").parquet(path).drop("fit")
    bare = result.lines.select("company").distinct().join(nodes.select("company").distinct(), "company", "left_anti")
    if not bare.isEmpty():
        raise ValueError(_NO_TREES)
    return FittedTrees(result, nodes)


def _nodes(spark: SparkSession, company: str, model: str, fitted: FittedModel) -> DataFrame:
    rows = []
    for number, tree in enumerate(fitted.trees):
        own = (company, model, tree.depth, number, fitted.settings.weight(number))
        rows += [(*own, *node) for node in _numbered(tree, fitted.bins)]
    return spark.createDataFrame(rows, _NODES)


def _numbered(tree: Tree, bins: Bins) -> list[tuple]:
    """A tree's nodes from the root on, left before right, numbered without gaps."""
    names = [*bins.numbers, *bins.texts]
    found: list[tuple] = []

    def visit(i: int) -> int:
        here = len(found)
        found.append(())
        about = (here, int(tree.n[i]), float(tree.total[i] / tree.n[i]))
        f = int(tree.feature[i])
        if f < 0:
            found[here] = (*about, None, None, None, None, None, None)
            return here
        left, right = visit(2 * i + 1), visit(2 * i + 2)
        cut = int(tree.cut[i])
        if f < len(bins.numbers):
            found[here] = (*about, names[f], None, float(bins.thresholds[f][cut]), None, left, right)
        else:
            found[here] = (*about, names[f], cut, None, [1.0 if tree.flipped[i] else 0.0], left, right)
        return here

    visit(0)
    return found


def score_trees(lines: DataFrame, encoded: Encoded, nodes: DataFrame) -> DataFrame:
    """``lines`` of this encoding with ``model`` and ``prediction``, as the trees have it.

    Each line is joined with one row that holds all trees of its company, whose size does not
    grow with the lines, and walks them in an expression: no line is repeated per tree.
    A company without trees has no lines in the result. Predictions may be negative.
    """
    names = [*encoded.numbers, *encoded.texts]
    trees = keep(_trees_by_company(nodes, names), "trees_by_company")
    depth = max(trees.agg(F.max("depth")).first()[0] or 0, 1)
    seen = F.array(
        *[F.col(f"{c}_scaled").cast("double") for c in encoded.numbers],
        *[F.col(f"{c}_slot").cast("double") for c in encoded.texts],
    )
    every = F.transform("trees", lambda tree: tree["weight"] * _walked(tree["nodes"], F.col("__seen"), depth))
    total = F.aggregate(every, F.lit(0.0), lambda sum_, value: sum_ + value)
    weight = F.aggregate("trees", F.lit(0.0), lambda sum_, tree: sum_ + tree["weight"])
    is_mean = F.col("model").isin([m for m, how in COMBINED.items() if how == "mean"])
    return (
        lines.withColumn("__seen", seen)
        .join(trees.drop("depth"), "company")
        .withColumn("prediction", F.when(is_mean, total / weight).otherwise(total))
        .drop("__seen", "trees")
    )


def _trees_by_company(nodes: DataFrame, names: list[str]) -> DataFrame:
    """One row per company and model: its trees in order, each with its nodes by number."""
    place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("feature")).cast("int") - 1
    one = F.struct(
        "node",
        place.alias("place"),
        F.col("slot").cast("double").alias("slot"),
        "threshold",
        "left_values",
        "left",
        "right",
        "value",
    )
    by_tree = nodes.groupBy("company", "model", "max_depth", "tree", "weight").agg(F.array_sort(F.collect_list(one)).alias("nodes"))
    return by_tree.groupBy("company", "model").agg(
        F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("trees"),
        F.max("max_depth").alias("depth"),
    )


def _walked(nodes: Column, seen: Column, depth: int) -> Column:
    """The value of the leaf that a line reaches."""

    def step(at: Column) -> Column:
        node = nodes[at]
        value = seen[node["place"]]
        x = F.when(node["slot"].isNull(), value).otherwise((value == node["slot"]).cast("double"))
        is_left = F.when(node["threshold"].isNotNull(), x <= node["threshold"]).otherwise(
            F.array_contains(node["left_values"], x)
        )
        return F.when(node["left"].isNull(), at).when(is_left, node["left"]).otherwise(node["right"])

    end = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda at, _: step(at))
    return nodes[end]["value"]
