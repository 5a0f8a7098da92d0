"""Demand forecasts: one model per company, fitted on all rounds but the last."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.expressions import at_least_zero, whole_units
from ..operators.binned_trees import Bins, Settings, Tree, boost_trees, find_bins, fit_trees, predict_trees
from ..operators.encoding import TARGET, Encoded, encode
from ..sources.scratch import enable_checkpoints, keep, new_path
from ..sources.store import Store
from . import ridge

_FOLDER = "company_folder"


def _folder(company: Column) -> Column:
    return F.hex(F.xxhash64(company))


#: Ridge is fitted for all companies at once, so it has no settings of its own.
MODELS = {
    "ridge": None,
    "forest": Settings(trees=100, depth=5, least=5),
    "boosting": Settings(trees=200, depth=3, least=1, rate=0.05),
}


@dataclass(frozen=True)
class FittedModel:
    """The trees of one company, and how its lines are binned for them."""

    settings: Settings
    bins: Bins
    trees: list[Tree]


@dataclass(frozen=True)
class Forecast:
    """What a model predicted for the last round of each company.

    ``lines``: company, product, round, line_no, model, demand, prediction (at
    least 0) and forecast (whole units). The forecast for the round to come is
    the prediction for the last one, as no feature is rolled forward.
    ``skipped``: companies whose lines are all in one round. ``failed``: what ended the
    fit of a company; the forecasts of the others are there all the same.
    """

    lines: DataFrame
    skipped: list
    failed: dict

    def all_lines(self) -> DataFrame:
        """``lines``, if no fit failed; otherwise an error that names the companies."""
        if self.failed:
            raise RuntimeError(f"the fit failed: {'; '.join(f'{c}: {why}' for c, why in self.failed.items())}")
        return self.lines


@dataclass(frozen=True)
class Ledger:
    """What became of each company's fit, in a folder that outlasts the session.

    A fit that ended has an entry, written after its lines: the company and why it failed,
    if it did. A rerun fits what has no entry or failed; lines without an entry are
    written over.
    """

    store: Store
    folder: str

    def _entry(self, company: str) -> str:
        return f"{self.folder}/_ended/{fit_name(company)}.json"

    def succeeded(self, company: str) -> bool:
        entry = self.store.read(self._entry(company))
        return entry is not None and json.loads(entry)["failure"] is None

    def record(self, company: str, failure: str | None) -> None:
        self.store.write(self._entry(company), json.dumps({"company": company, "failure": failure}))


def fit_name(company: str) -> str:
    return hashlib.sha256(company.encode()).hexdigest()[:32]


def forecast_metrics(lines: DataFrame, keys: tuple[str, ...] = ("company", "model")) -> DataFrame:
    """Mean absolute error and R² of the test rows.

    With a constant label R² is 1 for a perfect prediction and 0 otherwise.
    """
    y, p = F.col(TARGET), F.col("prediction")
    sums = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_lines"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("squared_error"),
        (F.var_pop(y) * F.count(y)).alias("squared_spread"),
    )
    r2 = F.when(
        F.col("squared_spread") != 0, 1 - F.col("squared_error") / F.col("squared_spread")
    ).otherwise(F.when(F.col("squared_error") == 0, 1.0).otherwise(0.0))
    return sums.select(*keys, "test_lines", "mae", r2.alias("r2"))


def prepare_training(features: DataFrame, columns: tuple[str, ...] | None = None, by_company: bool = True) -> Encoded:
    """Encode once and lay the lines out by company, so that a model reads only
    the files of its own company. A company with many lines gets many files. Folders
    are named by a hash, as not every name makes a folder (an empty one does not).

    Ridge reads all companies at once; for it alone, ``by_company=False`` leaves the lines where
    they are. The features should be written already, as they are read several times.
    """
    encoded = encode(features, columns)
    if not by_company:
        return encoded
    by_company = encoded.lines.withColumn(_FOLDER, _folder(F.col("company"))).hint("rebalance", _FOLDER)
    kept = keep(by_company, "encoded_lines", partition_by=(_FOLDER,))
    return Encoded(kept, encoded.statistics, encoded.categories, encoded.numbers, encoded.texts)


def forecast(
    features: DataFrame,
    model: str,
    columns: tuple[str, ...] | None = None,
    company: str | None = None,
    parallelism: int = 8,
) -> Forecast:
    """Fit ``model`` per company and predict its last round."""
    _check_model(model)
    if company is not None:
        features = features.where(F.col("company") == company)
    return forecast_encoded(prepare_training(features, columns, by_company=model != "ridge"), model, company, parallelism)


def _check_model(model: str) -> None:
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; choose one of {', '.join(MODELS)}")


def forecast_encoded(
    encoded: Encoded,
    model: str,
    company: str | None = None,
    parallelism: int = 8,
    on_fit: Callable[[Row, FittedModel, DataFrame], None] | None = None,
    ledger: Ledger | None = None,
) -> Forecast:
    """Like ``forecast``, on lines that are already encoded.

    Ridge is fitted for all companies in one job. Each fit of another model is distributed
    jobs over the company's lines; several companies are fitted at the same time. Only the
    statistics, one row per company, come to the driver. A fit that fails is reported and
    leaves the others alone. ``on_fit`` is called with the company's statistics, the fitted
    trees and its training lines; ridge does not call it. With a
    ``ledger``, fits that succeeded in an earlier run are not repeated; it must be the
    ledger of these very lines and this model. Ridge is one job and needs none.
    """
    _check_model(model)
    spark = encoded.lines.sparkSession
    enable_checkpoints(spark)
    statistics = encoded.statistics.orderBy("company").collect()
    ready = [row for row in statistics if row.n_train and row.n_test]
    skipped = [row.company for row in statistics if not (row.n_train and row.n_test)]
    if not ready:
        which = f"company {company}" if company is not None else "any company"
        raise ValueError(f"the lines of {which} cannot be split into training and test rounds")
    if model == "ridge":
        return _ridge_forecast(encoded, skipped)
    slots = _slot_counts(encoded)

    path = ledger.folder if ledger else new_path(spark, "forecast_lines")
    failed: dict = {}

    def fit(row: Row) -> None:
        if ledger and ledger.succeeded(row.company):
            return
        own = (F.col(_FOLDER) == _folder(F.lit(row.company))) & (F.col("company") == row.company)
        try:
            _fit_one(encoded.lines.where(own), encoded, row, slots.get(row.company, {}), model, f"{path}/fit={fit_name(row.company)}", on_fit)
        except Exception as failure:  # any fit may fail; what failed is told
            failed[row.company] = (str(failure).splitlines() or [type(failure).__name__])[0]
        if ledger:
            ledger.record(row.company, failed.get(row.company))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(ready)))) as pool:
        list(pool.map(fit, ready))
    if len(failed) == len(ready):
        raise RuntimeError(f"no fit succeeded; the first failure: {next(iter(failed.values()))}")
    lines = _forecast_lines(encoded.lines.withColumn("prediction", F.lit(0.0)), model)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)
    return Forecast(spark.read.schema(f"{schema}, fit string").parquet(path).drop("fit"), skipped, failed)


def _ridge_forecast(encoded: Encoded, skipped: list) -> Forecast:
    weights = ridge.ridge_weights(encoded, ridge.ROUNDS)
    failed = {
        row.company: f"ridge did not settle within {ridge.ROUNDS} rounds"
        for row in weights.where(~F.col("settled")).select("company").distinct().collect()
    }
    weights = weights.where("settled")
    if failed and weights.isEmpty():
        raise RuntimeError(f"no fit succeeded; the first failure: {next(iter(failed.values()))}")
    scored = ridge.predicted(encoded.lines.where("is_test"), encoded, weights)
    return Forecast(keep(_forecast_lines(scored, "ridge"), "forecast_lines"), skipped, failed)


def _slot_counts(encoded: Encoded) -> dict:
    if encoded.categories is None:
        return {}
    counts: dict = {}
    for row in encoded.categories.groupBy("company", "column").agg(F.max("slot").alias("most")).collect():
        counts.setdefault(row.company, {})[row.column] = row.most + 1
    return counts


def _fit_one(lines: DataFrame, encoded: Encoded, row: Row, slots: dict, model: str, path: str, on_fit=None) -> None:
    # A text with a single training category has no slot left: not a feature.
    texts = [c for c in encoded.texts if slots.get(c, 0) > 0]
    settings, training = MODELS[model], lines.where(~F.col("is_test"))
    bins = find_bins(training, row.n_train, encoded.numbers, texts, [slots[c] for c in texts], settings.seed)
    fit = fit_trees if settings.rate is None else boost_trees
    trees = fit(training, bins, settings, row.n_train)
    if on_fit is not None:
        on_fit(row, FittedModel(settings, bins, trees), training)
    scored = predict_trees(lines.where(F.col("is_test")), bins, trees, settings)
    _forecast_lines(scored, model).write.mode("overwrite").parquet(path)


def _forecast_lines(scored: DataFrame, model: str) -> DataFrame:
    return scored.select(
        "company",
        "product",
        "round",
        "line_no",
        F.lit(model).alias("model"),
        TARGET,
        at_least_zero("prediction").alias("prediction"),
        whole_units("prediction").alias("forecast"),
    )
