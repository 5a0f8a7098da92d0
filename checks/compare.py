"""Run the registered queries and compare them with their SQL in DuckDB.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from .oracle import oracle_sql
from .queries import queries
from .session import local_session

TABLES = "region nation customer supplier part orders lineitem".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs, or None. Values must be equal, not close."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    ours, theirs = canonical(ours), canonical(theirs)
    for c in ours.columns:
        same = (ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna())
        if not same.all():
            at = same[~same].index[0]
            return f"{c}: {(~same).sum()} values, first {ours[c][at]!r} against {theirs[c][at]!r}"
    return None


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session()
    connection = connect(sf_dir)
    sql, failed = oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        ours = query(spark, sf_dir).toPandas()
        seconds = time.time() - start
        found = difference(ours, connection.sql(sql[name]).df()) if name in sql else None
        failed += found is not None
        verdict = found or ("equal" if name in sql else "ran")
        print(f"{name:36s} {seconds:7.2f} s {len(ours):8d} rows  {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
