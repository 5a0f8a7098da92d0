"""The registered queries: each reads the test tables whole and returns a DataFrame.

The reports that need a forecast take three quarters of the demand of the line before
as one, so that SQL can state the same. The models have queries of their own, and
``forecast_checks`` and ``planning_identities`` hold what must be true of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.functions.expressions import round_half_even, whole_units
from stockloom.operators import aggregates
from stockloom.operators.encoding import encode
from stockloom.operators.rollup import last_rounds, product_rounds, sales_rounds
from stockloom.plans import comparison, exploration, planning
from stockloom.plans.fact import sales_fact
from stockloom.plans.features import demand_features, running_stock
from stockloom.plans.forecasting import forecast, forecast_encoded, forecast_metrics, prepare_training
from stockloom.plans.ridge import predicted, ridge_weights
from stockloom.plans.trees import fitted_trees, score_trees
from stockloom.sources.rejects import Loaded, read_csv_tables
from stockloom.sources.reports import write_report
from stockloom.sources.scratch import keep, new_path

from .star import VARIANTS, raw_tables, star_tables

ONE_COMPANY = "EUROPE"
Query = Callable[[SparkSession, str], DataFrame]


def _fact(spark: SparkSession, sf_dir: str, variant: str = "base", ordered: bool = False) -> DataFrame:
    return sales_fact(star_tables(spark, sf_dir, variant, kept=True), ordered=ordered)


def _features(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    return demand_features(_fact(spark, sf_dir, variant, ordered=True))


def _kept(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    return keep(_features(spark, sf_dir, variant), "features")


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_rounds(_features(spark, sf_dir))


def _last_demand(features: DataFrame, rounds: DataFrame) -> DataFrame:
    """Lines of the last round with part of the demand of the line before as forecast."""
    return (
        features.join(last_rounds(rounds), "company")
        .where(F.col("round") == F.col("last_round"))
        .withColumn("prediction", F.col("demand_lag1") * 0.75)
        .withColumn("forecast", whole_units("prediction"))
    )


def _planned(spark: SparkSession, sf_dir: str, variant: str = "base") -> tuple[DataFrame, DataFrame]:
    features = _kept(spark, sf_dir, variant)
    rounds = product_rounds(features)
    by_product = planning.product_forecast(_last_demand(features, rounds))
    return rounds, planning.planning_indicators(rounds, by_product)


def _of_table(step: Callable[[DataFrame], DataFrame], table: str, variant: str = "base") -> Query:
    return lambda spark, sf_dir: step(getattr(star_tables(spark, sf_dir, variant), table))


def _of_sales(report: Callable[[DataFrame], DataFrame]) -> Query:
    """Reports that need the sales lines only."""
    return lambda spark, sf_dir: report(sales_rounds(aggregates.sales_lines(star_tables(spark, sf_dir).sales)))


def _products(report: Callable[[DataFrame, list], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A matrix of all products in the data, in the order of their numbers."""

    def query(rounds: DataFrame) -> DataFrame:
        rounds = keep(rounds, "sales_rounds")
        names = [row.product for row in rounds.select("product").distinct().collect()]
        return report(rounds, sorted(names, key=lambda name: (len(name or ""), name or "")))

    return query


def _unnested(measure: str, width: int) -> Callable[[DataFrame], DataFrame]:
    """The cells of a matrix in blocks, one row each."""

    def query(rounds: DataFrame) -> DataFrame:
        blocks = exploration.matrix_blocks(keep(rounds, "sales_rounds"), measure, width)
        return blocks.select("company", "round", "block", F.explode("cells").alias("product", measure))

    return query


def _of_rounds(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(_rounds(spark, sf_dir))


def _of_indicators(report: Callable[[DataFrame], DataFrame], variant: str = "base") -> Query:
    return lambda spark, sf_dir: report(_planned(spark, sf_dir, variant)[1])


def _product_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _kept(spark, sf_dir)
    return planning.product_forecast(_last_demand(features, product_rounds(features)))


def _observed_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _kept(spark, sf_dir)
    lines = _last_demand(features, product_rounds(features))
    return lines.select("company", "product", "demand", "prediction", "forecast")


def _forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _kept(spark, sf_dir)
    metrics = forecast_metrics(_last_demand(features, product_rounds(features)), ("company",))
    return metrics.select("company", "test_lines", *[round_half_even(c, 6).alias(c) for c in ("mae", "r2")])


def _with_gaps(features: DataFrame) -> DataFrame:
    price_gap, area_gap = F.floor("net_sales") % 7 == 0, F.floor("cost") % 11 == 0
    return features.withColumns(
        {"net_price": F.when(~price_gap, F.col("net_price")), "area": F.when(~area_gap, F.col("area"))}
    )


def _prepared_features(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    features = _kept(spark, sf_dir)
    encoded = encode(_with_gaps(features) if gaps else features)
    scaled = [f"{c}_scaled" for c in encoded.numbers]
    return encoded.lines.select(
        "company", "product", "round", "demand", "is_test",
        *[round_half_even(c, 6).alias(c) for c in scaled],
        *[f"{c}_slot" for c in encoded.texts],
    )


def _forecast(model: str) -> Query:
    return lambda spark, sf_dir: forecast(_kept(spark, sf_dir), model).all_lines().drop("line_no")


def _forecast_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six decimals: the order of sums decides on the last digits of a double."""
    lines = _forecast("ridge")(spark, sf_dir)
    return lines.withColumn("prediction", round_half_even("prediction", 6))


def _forecast_checks(models: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        features = _kept(spark, sf_dir)
        last = last_rounds(features)
        mean = features.join(last, "company").where("round < last_round").groupBy("company").agg(F.avg("demand").alias("mean"))
        encoded = prepare_training(features)
        found = None
        for model in models:
            lines = forecast_encoded(encoded, model).all_lines()
            found = lines if found is None else found.unionByName(lines)
        error = F.avg(F.abs(F.col("demand") - F.col("prediction")))
        return found.join(mean, "company").groupBy("company", "model").agg(
            F.count(F.lit(1)).alias("test_lines"),
            F.bool_and(F.col("prediction") >= 0).alias("at_least_zero"),
            F.bool_and(F.col("forecast") == F.floor("prediction")).alias("whole_part"),
            (error <= F.avg(F.abs(F.col("demand") - F.col("mean")))).alias("beats_the_mean"),
        )

    return query


def _trees(model: str) -> Query:
    """Each company's trees as a table: how many, where the first one starts, and whether all of
    them, walked from that table, say of each line of the last round what the model said."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        encoded = prepare_training(_kept(spark, sf_dir))
        trees = fitted_trees(encoded, model)
        walked = score_trees(encoded.lines.where("is_test"), encoded, trees.nodes)
        said = trees.forecast.all_lines().select("company", "line_no", F.col("prediction").alias("said"))
        far = F.abs(F.greatest("prediction", F.lit(0.0)) - F.col("said")) > 1e-9 * (1 + F.col("said"))
        lines = walked.join(said, ["company", "line_no"], "left").groupBy("company", "model").agg(
            F.count(F.lit(1)).alias("test_lines"), F.bool_and(F.coalesce(~far, F.lit(False))).alias("walks_agree")
        )
        is_first = (F.col("tree") == 0) & (F.col("node") == 0)
        first = [F.max(F.when(is_first, F.col(c))).alias(c) for c in ("training_lines", "value")]
        roots = trees.nodes.groupBy("company").agg(F.countDistinct("tree").alias("trees"), *(first if model == "boosting" else []))
        if model == "boosting":
            roots = roots.withColumn("value", round_half_even("value", 6))
        return lines.join(roots, "company")

    return query


def _ridge_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each company and feature slot: is the gradient of the penalised loss 0 at the fitted weights?

    The gradient for slot k is sum(x_k * (prediction - demand)) + weight_k; it counts as 0 below
    a billionth of sum(|x_k * demand|) + 1.
    """
    encoded = prepare_training(_kept(spark, sf_dir), by_company=False)
    train = encoded.lines.where(~F.col("is_test"))
    scored = predicted(train, encoded, ridge_weights(encoded))
    numbers = [F.struct(F.lit(c).alias("feature"), F.lit(0).alias("slot"), F.col(f"{c}_scaled").alias("x")) for c in encoded.numbers]
    texts = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_slot").alias("slot"), F.lit(1.0).alias("x")) for c in encoded.texts]
    each = scored.select("company", "demand", (F.col("prediction") - F.col("demand")).alias("error"), F.inline(F.array(*numbers, *texts)))
    sums = each.where("slot >= 0").groupBy("company", "feature", "slot").agg(
        F.sum(F.col("x") * F.col("error")).alias("pull"), F.sum(F.abs(F.col("x") * F.col("demand"))).alias("size")
    )
    weights = ridge_weights(encoded).where("feature is not null").select("company", "feature", "slot", "weight")
    flat = F.abs(F.col("pull") + F.col("weight")) <= 1e-9 * (F.col("size") + 1)
    names = encoded.categories.select("company", F.col("column").alias("feature"), "slot", "value")
    return (
        sums.join(weights, ["company", "feature", "slot"], "left")
        .join(names, ["company", "feature", "slot"], "left")
        .select("company", F.concat_ws("=", "feature", "value").alias("feature"), F.coalesce(flat, F.lit(False)).alias("is_optimal"))
    )


def _planning_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators of a ridge forecast: what does not depend on it, and how the rest hangs together."""
    features = _kept(spark, sf_dir)
    by_product = planning.product_forecast(forecast(features, "ridge").all_lines())
    indicators = planning.planning_indicators(product_rounds(features), by_product)
    ahead, stock, price, unit = (F.col(c) for c in ("forecast_demand", "available_stock", "forecast_price", "mean_unit_cost"))
    cover = F.when(ahead != 0, F.rint(stock / ahead * 100 * 10) / 10).otherwise(0.0)
    return indicators.select(
        "company", "product", "available_stock", "forecast_price", "mean_unit_cost",
        (F.col("planned_production") == F.greatest(ahead - stock, F.lit(0.0))).alias("planned_is_lack"),
        (F.col("forecast_revenue") == ahead * price).alias("revenue_is_value"),
        (F.col("forecast_margin") == ahead * price - ahead * unit).alias("margin_is_rest"),
        (F.col("stock_cover_pct") == cover).alias("cover_is_share"),
    )


def _report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planning table, written as CSV and read back."""
    report = planning.planning_table(_planned(spark, sf_dir)[1])
    path = new_path(spark, "report")
    write_report(report, path, model="demand lag 1")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema.fields)
    return spark.read.schema(f"{schema}, model string").option("header", True).csv(path)


#: A compressed CSV file is read by one task.
_CSV_ROWS = 1_000_000


def _from_csv(spark: SparkSession, sf_dir: str) -> Loaded:
    """All tables as compressed CSV files, in which some cells of the sales are spoilt; read back."""
    raw = raw_tables(spark, sf_dir, kept=True)
    product, channel, rounds = F.col("MATERIAL_CODE"), F.col("DISTRIBUTION_CHANNEL"), F.col("SIM_ROUND")
    spoilt = {
        "NET_VALUE": F.when((product == "Brand#13") & (channel == "BUILDING"), "12,5"),
        "COST": F.when((rounds % 7 == 0) & (F.col("SALES_ORGANIZATION") == "ASIA"), "n/a"),
        "SIM_ROUND": F.when((product == "Brand#22") & (channel == "MACHINERY"), F.concat(rounds.cast("string"), F.lit(".5"))),
    }
    raw["sales"] = raw["sales"].withColumns({name: F.coalesce(cell, F.col(name).cast("string")) for name, cell in spoilt.items()})
    root = new_path(spark, "csv_tables")
    for name, df in raw.items():
        df.write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", _CSV_ROWS).csv(f"{root}/{name}")
    return read_csv_tables(spark, root)


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = _from_csv(spark, sf_dir).rejects
    return rejects.groupBy("table_name", "field", "cell", "reason").agg(F.count(F.lit(1)).alias("n"))


def _csv_sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sales_lines(_from_csv(spark, sf_dir).tables.sales)


def _company_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _kept(spark, sf_dir)
    return comparison.company_comparison(product_rounds(features), forecast(features, "ridge"))


def _demand_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.demand_timeline(*_planned(spark, sf_dir))


def _forecast_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds, indicators = _planned(spark, sf_dir)
    return planning.forecast_vs_history(indicators, rounds)


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "sales_lines": _of_table(aggregates.sales_lines, "sales"),
        "production_by_round": _of_table(aggregates.production_by_round, "production"),
        "marketing_by_round": _of_table(aggregates.marketing_by_round, "marketing"),
        "market_price": _of_table(aggregates.market_price, "market"),
        "market_price_company": _of_table(aggregates.market_price, "market", "market_by_company"),
        "opening_stock": _of_table(aggregates.opening_stock, "inventory"),
        "opening_stock_global": _of_table(aggregates.opening_stock, "inventory", "inventory_global"),
        "running_stock": lambda spark, sf_dir: running_stock(_fact(spark, sf_dir, ordered=True)).drop("line_no"),
        "company_list": _of_table(exploration.company_list, "sales"),
        "company_count": _of_table(exploration.company_count, "sales"),
        "company_overview": _of_sales(exploration.company_overview),
        "demand_by_round": _of_sales(exploration.demand_by_round),
        "sales_by_round": _of_sales(exploration.sales_by_round),
        "demand_matrix": _of_sales(_products(exploration.demand_matrix)),
        "sales_matrix": _of_sales(_products(exploration.sales_matrix)),
        "demand_matrix_blocks": _of_sales(_unnested("demand", 10)),
        "sales_matrix_blocks": _of_sales(_unnested("net_sales", 10)),
        "profile_numeric": lambda spark, sf_dir: exploration.profile_numeric(_kept(spark, sf_dir)),
        "profile_text": _of_table(exploration.profile_sales_text, "sales"),
        "last_round_stock": _of_rounds(exploration.last_round_stock),
        "product_forecast": _product_forecast,
        "planning_indicators": _of_indicators(lambda indicators: indicators),
        "planning_indicators_no_delivered": _of_indicators(lambda indicators: indicators, "no_delivered"),
        "planning_table": _of_indicators(planning.planning_table),
        "financial_summary": _of_indicators(planning.financial_summary),
        "forecast_vs_history": _forecast_vs_history,
        "demand_timeline": _demand_timeline,
        "requirement_recap": _of_indicators(planning.requirement_recap),
        "observed_vs_predicted": _observed_vs_predicted,
        "forecast_metrics": _forecast_metrics,
        "prepared_features": _prepared_features,
        "prepared_features_with_gaps": lambda spark, sf_dir: _prepared_features(spark, sf_dir, gaps=True),
        "report_export": _report_export,
        "csv_rejects": _csv_rejects,
        "csv_sales_lines": _csv_sales_lines,
        "planning_identities": _planning_identities,
        "ridge_optimality": _ridge_optimality,
        "forecast_checks": _forecast_checks(("ridge", "forest")),
        "forecast_checks_boosting": _forecast_checks(("boosting",)),
        "forest_trees": _trees("forest"),
        "boosting_trees": _trees("boosting"),
        "forecast_ridge": _forecast_ridge,
        "forecast_forest": _forecast("forest"),
        "forecast_boosting": _forecast("boosting"),
        "company_comparison": _company_comparison,
        "model_comparison": lambda spark, sf_dir: comparison.model_comparison(_kept(spark, sf_dir)),
        "demand_features_one_company": lambda spark, sf_dir: demand_features(
            _fact(spark, sf_dir, ordered=True), ONE_COMPANY
        ).drop("line_no"),
    }
    for variant in VARIANTS:
        suffix = "" if variant == "base" else f"_{variant}"
        named[f"sales_fact{suffix}"] = lambda spark, sf_dir, v=variant: _fact(spark, sf_dir, v).drop(
            aggregates.DELIVERED_KEY
        )
        named[f"demand_features{suffix}"] = lambda spark, sf_dir, v=variant: _features(
            spark, sf_dir, v
        ).drop("line_no")
    return named
