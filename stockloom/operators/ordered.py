"""Running totals and previous-row lookups in a total order, without big windows.

A plain window puts every row of its partition into one task. One product of one
company may hold a third of all rows, so the rows are ordered first: a range
exchange over the whole order cuts them into slices of similar size, however few
distinct groups there are, and each row is numbered. After that

* inside a slice, a window per (slice, group) sees at most one slice of rows;
* between slices, one summary row per (slice, group) carries the totals and the
  last row over. There are at most (slices + groups) of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import keep

# The row number holds the partition in its upper bits (documented behaviour of
# monotonically_increasing_id: 33 bits for the record within the partition).
_RECORD_BITS = 33


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows along ``order``: adds ``line_no`` and its ``slice``.

    ``order`` must identify a row, so that no slice can outgrow the others. The
    result is written before it is used: the numbers have to stay the same for
    every later step, and a lost executor must not draw new slice boundaries. Rows that
    are range-partitioned along ``order`` already are not moved again.
    """
    numbered = (
        df.sort(*order)
        .withColumn("line_no", F.monotonically_increasing_id())
        .withColumn("slice", F.shiftright("line_no", _RECORD_BITS).cast("int"))
    )
    return keep(numbered, name)


def along_order(
    ordered: DataFrame,
    group: list[str],
    running: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    first: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sums, previous-row values and first-row values per group.

    ``running`` maps a new column to the expression summed up to and including
    the row, ``previous`` to the column read from the row before, and ``first``
    to the column read from the first row of the group. The two lookups expect
    columns without nulls. The exchange on (group, slice) serves the window and
    the join alike.
    """
    running, previous, first = running or {}, previous or {}, first or {}
    keys = [*group, "slice"]

    totals = ordered.groupBy(*keys).agg(
        *[F.sum(expr).alias(f"{name}__total") for name, expr in running.items()],
        *[F.max_by(col, "line_no").alias(f"{name}__last") for name, col in previous.items()],
        *[F.min_by(col, "line_no").alias(f"{name}__first") for name, col in first.items()],
    )
    by_slice = Window.partitionBy(*group).orderBy("slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"{n}__total").over(earlier), F.lit(0)).alias(f"{n}__carried") for n in running],
        *[F.lag(f"{n}__last").over(by_slice).alias(f"{n}__carried") for n in previous],
        *[F.first(f"{n}__first").over(by_slice).alias(f"{n}__carried") for n in first],
    )

    in_slice = Window.partitionBy(*keys).orderBy("line_no")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windowed = ordered.select(
        "*",
        *[F.sum(expr).over(so_far).alias(f"{n}__inside") for n, expr in running.items()],
        *[F.lag(col).over(in_slice).alias(f"{n}__inside") for n, col in previous.items()],
    )
    return windowed.join(carried, keys).select(
        *ordered.columns,
        *[(F.col(f"{n}__carried") + F.col(f"{n}__inside")).alias(n) for n in running],
        *[F.coalesce(f"{n}__inside", f"{n}__carried").alias(n) for n in previous],
        *[F.col(f"{n}__carried").alias(n) for n in first],
    )
