"""Companies side by side, and models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import amount
from .forecasting import MODELS, Forecast, forecast_encoded, forecast_metrics, prepare_training
from .planning import planning_indicators, product_forecast


def company_comparison(rounds: DataFrame, forecast: Forecast) -> DataFrame:
    """Error metrics and planning totals, one row per company."""
    lines = forecast.all_lines()
    indicators = planning_indicators(rounds, product_forecast(lines))
    totals = indicators.groupBy("company").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("forecast_demand").alias("forecast_demand"),
        *[
            F.sum(amount(c)).cast("double").alias(c)
            for c in ("available_stock", "planned_production", "forecast_revenue", "forecast_margin")
        ],
    )
    return forecast_metrics(lines).join(totals, "company").orderBy("company")


def model_comparison(features: DataFrame, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """Error metrics, one row per company and model. The lines are encoded once."""
    encoded = prepare_training(features)
    lines = None
    for model in models:
        scored = forecast_encoded(encoded, model).all_lines()
        lines = scored if lines is None else lines.unionByName(scored)
    return forecast_metrics(lines).orderBy("company", "model")
