"""A company whose fit failed must not be missing without a sign."""

from __future__ import annotations

import pytest

from checks import queries
from stockloom.plans import comparison
from stockloom.plans.forecasting import Forecast


def test_failed_fits_are_errors(monkeypatch):
    failed = Forecast(None, [], {"A": "out of memory"})
    monkeypatch.setattr(comparison, "prepare_training", lambda features: None)
    monkeypatch.setattr(comparison, "forecast_encoded", lambda encoded, model: failed)
    monkeypatch.setattr(queries, "forecast", lambda features, model: failed)
    monkeypatch.setattr(queries, "_kept", lambda spark, sf_dir: None)
    registered = queries.queries()
    for name in ("forecast_ridge", "forecast_forest", "forecast_boosting", "model_comparison"):
        with pytest.raises(RuntimeError, match="A: out of memory"):
            registered[name](None, "")
    with pytest.raises(RuntimeError, match="A: out of memory"):
        comparison.company_comparison(None, failed)


def test_workbench_tells_of_failed_fits(monkeypatch):
    from stockloom.plans import workbench

    monkeypatch.setattr(workbench.Workbench, "forecast", lambda self, model: Forecast(None, [], {"A": "out of memory"}))
    bench = workbench.Workbench(None)
    for report in (bench.metrics, bench.product_forecast):
        with pytest.raises(RuntimeError, match="A: out of memory"):
            report("ridge")
