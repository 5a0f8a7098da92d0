"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PARTITIONS = ("company", "model")


def write_report(
    report: DataFrame,
    path: str,
    model: str | None = None,
    file_format: str = "csv",
    mode: str = "errorifexists",
) -> None:
    """Write a report as CSV with a header, or as parquet.

    One folder per company, and per model if the report has one or ``model`` is
    given. Blanks in a model name become underscores.
    """
    if model is not None:
        report = report.withColumn("model", F.lit(model))
    folders = [c for c in PARTITIONS if c in report.columns]
    if "model" in folders:
        report = report.withColumn("model", F.regexp_replace("model", " ", "_"))
    # Small reports end up in one file per folder, large ones in several.
    writer = (report.hint("rebalance", *folders) if folders else report).write.mode(mode)
    if folders:
        writer = writer.partitionBy(*folders)
    if file_format == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8")
    writer.format(file_format).save(path)
