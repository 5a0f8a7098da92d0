"""Exact quantiles with linear interpolation, for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
task. Here the approximate one, which is a small mergeable sketch, only brackets
each quantile; the values inside the bracket are counted and ranked exactly.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import keep
from .ordered import along_order, in_order

# The sketch is off by at most one in ACCURACY of the ranks; the bracket is drawn
# MARGIN (a share of the ranks) out on either side. Whether it holds the wanted
# ranks is counted, and a quantile outside its bracket is looked for again
# between the least and the largest value.
ACCURACY = 10_000
MARGIN = 0.002


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probabilities: list[float],
    margin: float = MARGIN,
) -> DataFrame:
    """Quantiles of each of ``columns`` per ``keys``; nulls are left out.

    Returns ``keys``, ``column``, ``probability`` and ``quantile``, without a row
    for a column that has no value in the group. The rows are read three times:
    for the sketches, to count what lies below the brackets, and to take out
    what lies inside. Only the last, a small part of large groups, is shuffled.
    """
    values = df.select(*keys, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    targets = [(i, j) for i in range(len(columns)) for j in range(len(probabilities))]

    brackets = keep(_brackets(values, keys, len(columns), probabilities, margin), "quantile_brackets")
    found = keep(_inside(values, brackets, keys, columns, targets, probabilities), "quantiles")
    missed = found.where("missed")
    if not missed.isEmpty():
        flags = missed.groupBy(*keys).agg(
            *[F.bool_or((F.col("i") == i) & (F.col("j") == j)).alias(f"missed{i}_{j}") for i, j in targets]
        )
        whole = keep(
            brackets.join(flags, keys).select(
                *keys,
                *[f"{name}{i}" for i in range(len(columns)) for name in ("n", "least", "most")],
                *[
                    F.when(F.col(f"missed{i}_{j}"), F.col(f"{otherwise}{i}")).alias(f"{end}{i}_{j}")
                    for i, j in targets
                    for end, otherwise in (("low", "least"), ("high", "most"))
                ],
            ),
            "quantile_brackets",
        )
        found = found.where(~F.col("missed")).unionByName(_inside(values, whole, keys, columns, targets, probabilities))
    name = F.array(*[F.lit(c) for c in columns])[F.col("i")]
    probability = F.array(*[F.lit(float(p)) for p in probabilities])[F.col("j")]
    return found.select(*keys, name.alias("column"), probability.alias("probability"), "quantile")


def _inside(
    values: DataFrame,
    brackets: DataFrame,
    keys: list[str],
    columns: list[str],
    targets: list[tuple[int, int]],
    probabilities: list[float],
) -> DataFrame:
    """``keys``, ``i``, ``j``, ``quantile`` and whether the bracket missed it.

    Brackets without a lower end are passed over.
    """
    group = [*keys, "i", "j"]
    bracketed = values.join(
        brackets.select(*keys, *[f"{end}{i}_{j}" for i, j in targets for end in ("low", "high")]), keys
    )
    counted = bracketed.groupBy(*keys).agg(
        *[
            F.count_if(hit(F.col(f"v{i}"), F.col(f"low{i}_{j}"), F.col(f"high{i}_{j}"))).alias(f"{count}{i}_{j}")
            for i, j in targets
            for count, hit in (
                ("below_low", lambda v, low, high: v < low),
                ("up_to_low", lambda v, low, high: v <= low),
                ("up_to_high", lambda v, low, high: v <= high),
            )
        ]
    )
    places = keep(_places(brackets.join(counted, keys), keys, targets, probabilities), "quantile_places")

    # Values equal to an end need no ranking, so that a value shared by many rows
    # is never taken out; equal values inside become one row each. Few rows pass
    # the filter, and it is kept small for the compiler: one column at a time.
    per_column = brackets.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        *[F.col(f"{end}{i}_{j}").alias(f"{end}{j}") for j in range(len(probabilities)) for end in ("low", "high")],
                    )
                    for i in range(len(columns))
                ]
            )
        ),
    )
    per_value = values.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value")) for i in range(len(columns))])),
    )
    inside = [(F.col("value") > F.col(f"low{j}")) & (F.col("value") < F.col(f"high{j}")) for j in range(len(probabilities))]
    counts = (
        per_value.join(per_column, [*keys, "i"])
        .where(reduce(or_, inside))
        .select(*keys, "i", "value", F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(j)) for j, hit in enumerate(inside)]))).alias("j"))
        .groupBy(*group, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = along_order(
        in_order(counts, [*group, "value"], "quantile_counts"), group, running={"up_to": F.col("n")}
    )

    def found(rank: str) -> Column:
        hit = (F.col("up_to") > F.col(rank)) & (F.col("up_to") - F.col("n") <= F.col(rank))
        return F.max(F.when(hit, F.col("value"))).alias(f"{rank}_value")

    ranks = ranked.join(places.select(*group, "low_rank", "high_rank"), group)
    hits = ranks.groupBy(*group).agg(F.max("up_to").alias("inside"), found("low_rank"), found("high_rank"))

    def at(rank: str) -> Column:
        return (
            F.when(F.col(rank) < 0, F.col("low"))
            .when(F.col(rank) >= F.coalesce("inside", F.lit(0)), F.col("high"))
            .otherwise(F.col(f"{rank}_value"))
        )

    return places.join(hits, group, "left").select(
        *group,
        _between(at("low_rank"), at("high_rank"), F.col("fraction")).alias("quantile"),
        "missed",
    )


def _between(low: Column, high: Column, t: Column) -> Column:
    """Linear interpolation from the nearer end, as numpy does it."""
    return F.when(t >= 0.5, high - (high - low) * (1 - t)).otherwise(low + (high - low) * t)


def _brackets(values: DataFrame, keys: list[str], width: int, probabilities: list[float], margin: float) -> DataFrame:
    """One row per group: count, extremes, and the ends of each bracket."""
    ends = [end for p in probabilities for end in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketches = values.groupBy(*keys).agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(width)],
        *[F.min(f"v{i}").alias(f"least{i}") for i in range(width)],
        *[F.max(f"v{i}").alias(f"most{i}") for i in range(width)],
        *[F.percentile_approx(f"v{i}", ends, ACCURACY).alias(f"ends{i}") for i in range(width)],
    )
    return sketches.select(
        *keys,
        *[f"{name}{i}" for i in range(width) for name in ("n", "least", "most")],
        *[
            F.col(f"ends{i}")[2 * j + k].alias(f"{end}{i}_{j}")
            for i in range(width)
            for j in range(len(probabilities))
            for k, end in enumerate(("low", "high"))
        ],
    )


def _places(sized: DataFrame, keys: list[str], targets: list[tuple[int, int]], probabilities: list[float]) -> DataFrame:
    """Where each quantile lies: two ranks counted from the first value inside
    its bracket, and how far to go from one to the other. A negative rank is the
    lower end of the bracket, one past the values inside is the upper end."""

    def place(i: int, j: int) -> Column:
        rank = (F.col(f"n{i}") - 1) * F.lit(float(probabilities[j]))
        skipped = F.col(f"up_to_low{i}_{j}")
        return F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.col(f"low{i}_{j}").alias("low"),
            F.col(f"high{i}_{j}").alias("high"),
            (F.floor(rank) - skipped).alias("low_rank"),
            (F.ceil(rank) - skipped).alias("high_rank"),
            (rank - F.floor(rank)).alias("fraction"),
            ((F.floor(rank) < F.col(f"below_low{i}_{j}")) | (F.ceil(rank) >= F.col(f"up_to_high{i}_{j}"))).alias("missed"),
        )

    each = sized.select(*keys, F.inline(F.array(*[place(i, j) for i, j in targets])))
    return each.where(F.col("low").isNotNull())
