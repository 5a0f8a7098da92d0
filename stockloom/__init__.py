"""Demand forecasting and production planning on Spark.

>>> from stockloom import Workbench, read_tables
>>> bench = Workbench(read_tables(spark, "/data/planning"))   # doctest: +SKIP
>>> bench.planning_table("ridge").show()                             # doctest: +SKIP
"""

from .operators.aggregates import (
    market_price,
    marketing_by_round,
    opening_stock,
    production_by_round,
    sales_lines,
)
from .operators.rollup import last_rounds, product_rounds, product_totals, sales_rounds
from .plans.comparison import company_comparison, model_comparison
from .plans.exploration import (
    company_count,
    company_list,
    company_overview,
    demand_by_round,
    demand_matrix,
    last_round_stock,
    profile_numeric,
    profile_sales_text,
    profile_text,
    sales_by_round,
    matrix_blocks,
    sales_matrix,
)
from .plans.fact import sales_fact
from .plans.features import demand_features, running_stock
from .plans.forecasting import MODELS, Forecast, forecast, forecast_metrics
from .plans.planning import (
    demand_timeline,
    financial_summary,
    forecast_vs_history,
    planning_indicators,
    planning_table,
    product_forecast,
    requirement_recap,
)
from .plans.trees import FittedTrees, fitted_trees, score_trees
from .plans.workbench import Workbench
from .sources.contract import ContractError
from .sources.rejects import Loaded, read_csv_tables
from .sources.reports import write_report
from .sources.scratch import release
from .sources.tables import Tables, catalog_tables, read_tables

__all__ = [
    "ContractError",
    "Forecast",
    "FittedTrees",
    "Loaded",
    "MODELS",
    "Tables",
    "Workbench",
    "catalog_tables",
    "company_comparison",
    "company_count",
    "company_list",
    "company_overview",
    "demand_by_round",
    "demand_features",
    "demand_matrix",
    "demand_timeline",
    "financial_summary",
    "fitted_trees",
    "forecast",
    "forecast_metrics",
    "forecast_vs_history",
    "last_round_stock",
    "last_rounds",
    "market_price",
    "marketing_by_round",
    "model_comparison",
    "opening_stock",
    "planning_indicators",
    "planning_table",
    "product_forecast",
    "product_rounds",
    "product_totals",
    "production_by_round",
    "profile_numeric",
    "profile_sales_text",
    "profile_text",
    "read_csv_tables",
    "read_tables",
    "release",
    "requirement_recap",
    "running_stock",
    "sales_by_round",
    "sales_fact",
    "sales_lines",
    "matrix_blocks",
    "sales_matrix",
    "sales_rounds",
    "score_trees",
    "write_report",
]
