"""All reports on one set of tables, with the shared steps computed once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators.encoding import Encoded
from ..operators.rollup import product_rounds
from ..sources.scratch import keep, release
from ..sources.store import Store
from ..sources.tables import Tables
from . import comparison, exploration, planning
from .fact import sales_fact
from .features import demand_features
from .forecasting import Forecast, Ledger, forecast_encoded, forecast_metrics, prepare_training
from .trees import FittedTrees, fitted_trees, score_trees


class Workbench:
    """Keeps the fact's features, their rollup and the fitted forecasts.

    Every result holds all companies; ``where(company == ...)`` gives one. With
    ``company``, only its lines are read and computed from the start. With ``store``, a
    shared folder, features, rounds and fits outlast the session: a later workbench on the
    same input files finds them, and one on changed files builds them anew.
    """

    def __init__(self, tables: Tables, company: str | None = None, store: str | None = None):
        self.tables = tables
        self.company = company
        self.store = Store(tables.sales.sparkSession, store) if store else None
        self._forecasts: dict[str, Forecast] = {}
        self._trees: dict[str, FittedTrees] = {}

    @cached_property
    def _places(self) -> dict[str, str | None]:
        """The stored tables' folders; all of them depend on the five tables and the company."""
        sources = [getattr(self.tables, field.name) for field in fields(self.tables)]
        features = self.store.name_of("features", sources, {"company": self.company})
        return {step: features and features.replace("/features-", f"/{step}-") for step in ("features", "rounds", "fits")}

    def _stored(self, step: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self.store is None:
            return keep(build(), step)
        return self.store.table(self._places[step], build, lambda df: keep(df, step))

    def __enter__(self) -> Workbench:
        return self

    def __exit__(self, *failure) -> None:
        """Delete the intermediate tables; results that were not written end with them."""
        release(self.tables.sales.sparkSession)

    @cached_property
    def fact(self) -> DataFrame:
        return sales_fact(self.tables, self.company)

    @cached_property
    def features(self) -> DataFrame:
        fact = lambda: sales_fact(self.tables, self.company, ordered=True)
        features = self._stored("features", lambda: demand_features(fact(), self.company))
        if self.company is not None and features.isEmpty():
            raise ValueError(f"no usable lines for company {self.company}")
        return features

    @cached_property
    def rounds(self) -> DataFrame:
        if self.store is None:
            return product_rounds(self.features)
        return self._stored("rounds", lambda: product_rounds(self.features))

    @cached_property
    def encoded(self) -> Encoded:
        return prepare_training(self.features)

    def forecast(self, model: str) -> Forecast:
        if model not in self._forecasts:
            self._forecasts[model] = forecast_encoded(self.encoded, model, self.company, ledger=self._ledger(model))
        return self._forecasts[model]

    def _ledger(self, fits: str) -> Ledger | None:
        place = self._places["fits"] if self.store else None
        return Ledger(self.store, f"{place}/{fits}") if place else None

    def fitted(self, model: str) -> FittedTrees:
        """The forest or the boosted trees of each company, kept as a table; the model's reports use the same fit."""
        if model not in self._trees:
            ledger = self._ledger(f"{model}-trees")
            self._trees[model] = fitted_trees(self.encoded, model, self.company, ledger=ledger)
            self._forecasts[model] = self._trees[model].forecast
        return self._trees[model]

    def fitted_lines(self, model: str) -> DataFrame:
        """All lines, those of the training rounds too, with what the trees say of them."""
        return score_trees(self.encoded.lines, self.encoded, self.fitted(model).nodes)

    def metrics(self, model: str) -> DataFrame:
        return forecast_metrics(self.forecast(model).all_lines())

    def companies(self) -> DataFrame:
        return exploration.company_list(self.tables.sales)

    def overview(self) -> DataFrame:
        return exploration.company_overview(self.rounds)

    def company_count(self) -> DataFrame:
        return exploration.company_count(self.tables.sales)

    def demand_by_round(self) -> DataFrame:
        return exploration.demand_by_round(self.rounds)

    def sales_by_round(self) -> DataFrame:
        return exploration.sales_by_round(self.rounds)

    def demand_matrix(self, products: list) -> DataFrame:
        return exploration.demand_matrix(self.rounds, products)

    def sales_matrix(self, products: list) -> DataFrame:
        return exploration.sales_matrix(self.rounds, products)

    def matrix_blocks(self, measure: str, width: int = 1000) -> DataFrame:
        return exploration.matrix_blocks(self.rounds, measure, width)

    def profile_numeric(self) -> DataFrame:
        return exploration.profile_numeric(self.features)

    def profile_text(self) -> DataFrame:
        return exploration.profile_text(self.features)

    def last_round_stock(self) -> DataFrame:
        return exploration.last_round_stock(self.rounds)

    def product_forecast(self, model: str) -> DataFrame:
        return planning.product_forecast(self.forecast(model).all_lines())

    def indicators(self, model: str) -> DataFrame:
        return planning.planning_indicators(self.rounds, self.product_forecast(model))

    def planning_table(self, model: str) -> DataFrame:
        return planning.planning_table(self.indicators(model))

    def financial_summary(self, model: str) -> DataFrame:
        return planning.financial_summary(self.indicators(model))

    def forecast_vs_history(self, model: str) -> DataFrame:
        return planning.forecast_vs_history(self.indicators(model), self.rounds)

    def demand_timeline(self, model: str) -> DataFrame:
        return planning.demand_timeline(self.rounds, self.indicators(model))

    def requirement_recap(self, model: str) -> DataFrame:
        return planning.requirement_recap(self.indicators(model))

    def company_comparison(self, model: str) -> DataFrame:
        return comparison.company_comparison(self.rounds, self.forecast(model))
