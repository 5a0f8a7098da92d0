"""Ridge for all companies at once, from sufficient statistics.

The closed form needs the lines only through sums: of products of two columns, and of
columns over the lines of a category. So the lines are read once and brought down to
one row per company and combination of categories; everything after that works on these.
A company's equations are sparse, as a line has one category of each text, and are
solved by conjugate gradients, all companies in one job. The number of jobs does not
depend on the number of companies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.encoding import TARGET, Encoded
from ..sources.scratch import keep

PENALTY = 1.0
#: Rounds of conjugate gradients, each of as many steps as there are features, and the size
#: of a gradient that counts as 0, against the sums it is made of.
ROUNDS, PRECISION = 20, 1e-11

# Columns of the equations: the constant, the target, the numbers, then the texts. A column
# of a text has a slot per category; the others have slot 0.
_ONE, _TARGET, _FIRST = 0, 1, 2
_ENTRY = "company string, a int, a_slot int, b int, b_slot int, value double"
_WEIGHT = "company string, column int, slot int, weight double, settled boolean"


def equations(encoded: Encoded) -> DataFrame:
    """Sums of products of two columns over the training lines; each pair once, zeros left out."""
    train = encoded.lines.where(~F.col("is_test"))
    dense = [F.lit(1.0), F.col(TARGET), *[F.col(f"{c}_scaled") for c in encoded.numbers]]
    pairs = [(a, b) for a in range(len(dense)) for b in range(a, len(dense))]
    slots = [f"{c}_slot" for c in encoded.texts]
    cells = keep(
        train.groupBy("company", *slots).agg(*[F.sum(dense[a] * dense[b]).alias(f"s{a}_{b}") for a, b in pairs]), "ridge_cells"
    )

    def entries(rows: DataFrame, *found: tuple) -> DataFrame:
        of = lambda a, a_slot, b, b_slot, value: F.struct(
            F.lit(a).alias("a"), a_slot.alias("a_slot"), F.lit(b).alias("b"), b_slot.alias("b_slot"), value.alias("value")
        )
        return rows.select("company", F.inline(F.array(*[of(*entry) for entry in found]))).where("value != 0")

    none = F.lit(0)
    whole = cells.groupBy("company").agg(*[F.sum(f"s{a}_{b}").alias(f"s{a}_{b}") for a, b in pairs])
    parts = [entries(whole, *[(a, none, b, none, F.col(f"s{a}_{b}")) for a, b in pairs])]
    for i, slot in enumerate(slots):
        # A line without a slot adds nothing to a column of this text.
        of_text = cells.where(F.col(slot) >= 0).groupBy("company", F.col(slot).alias("slot"))
        sums = of_text.agg(*[F.sum(f"s{_ONE}_{b}").alias(f"s{b}") for b in range(len(dense))])
        me, mine = len(dense) + i, F.col("slot")
        parts.append(entries(sums, (me, mine, me, mine, F.col(f"s{_ONE}")), *[(b, none, me, mine, F.col(f"s{b}")) for b in range(len(dense))]))
        for j, other in enumerate(slots[:i]):
            both = cells.where((F.col(slot) >= 0) & (F.col(other) >= 0)).groupBy("company", F.col(other).alias("other"), F.col(slot).alias("slot"))
            parts.append(entries(both.agg(F.sum(f"s{_ONE}_{_ONE}").alias("n")), (len(dense) + j, F.col("other"), me, mine, F.col("n"))))
    return keep(reduce(DataFrame.unionByName, parts), "ridge_equations")


def solve(product: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, right: np.ndarray, rounds: int) -> tuple[np.ndarray, bool]:
    """Conjugate gradients, begun anew from the true gradient in every round. Tells whether the
    gradient became 0, against the size of the sums that it is the difference of."""
    weights = np.zeros_like(right)
    scale = PRECISION * (np.abs(right) + np.sqrt(diagonal) * np.sqrt(np.abs(right).max(initial=0.0)) + 1.0)
    for _ in range(rounds):
        left = right - product(weights)
        if (np.abs(left) <= scale).all():
            return weights, True
        ahead = left / diagonal
        step, size = ahead, left @ ahead
        for _ in range(len(right)):
            moved = product(step)
            along = step @ moved
            if along <= 0 or size <= 0:
                break
            weights = weights + size / along * step
            left = left - size / along * moved
            ahead = left / diagonal
            size, before = left @ ahead, size
            step = ahead + size / before * step
    return weights, bool((np.abs(right - product(weights)) <= scale).all())


def _weights_of(rounds: int):
    def of_company(entries: pd.DataFrame) -> pd.DataFrame:
        names = pd.concat([entries[["a", "a_slot"]].set_axis(["c", "s"], axis=1), entries[["b", "b_slot"]].set_axis(["c", "s"], axis=1)])
        names = names.drop_duplicates().sort_values(["c", "s"]).reset_index(drop=True)
        place = pd.Series(names.index, index=pd.MultiIndex.from_frame(names))
        a = place.reindex(pd.MultiIndex.from_frame(entries[["a", "a_slot"]])).to_numpy()
        b = place.reindex(pd.MultiIndex.from_frame(entries[["b", "b_slot"]])).to_numpy()
        value = entries["value"].to_numpy()

        n, column = len(names), names["c"].to_numpy()
        of_one = np.zeros(n)  # sums of the columns
        of_one[b[a == 0]] = value[a == 0]
        count, is_feature = of_one[0], column >= _FIRST
        target = np.flatnonzero(column == _TARGET)
        of_target, mean = np.zeros(n), 0.0
        if target.size:  # a target that is 0 on all lines has no entry
            mean = of_one[target[0]] / count
            of_target[b[a == target[0]]] = value[a == target[0]]
            of_target[a[b == target[0]]] = value[b == target[0]]
        own = is_feature[a] & is_feature[b]
        rows, columns, sums = a[own], b[own], value[own]
        aside = rows != columns
        rows, columns = np.concatenate((rows, columns[aside])), np.concatenate((columns, rows[: len(own[own])][aside]))
        sums = np.concatenate((sums, sums[aside]))

        def product(weights: np.ndarray) -> np.ndarray:
            """Centred sums of products, and the penalty."""
            found = np.bincount(rows, sums * weights[columns], minlength=n) + PENALTY * weights
            return np.where(is_feature, found - of_one * (of_one @ np.where(is_feature, weights, 0.0)) / count, 0.0)

        diagonal = np.full(n, PENALTY)
        here = rows == columns
        diagonal[rows[here]] += sums[here]
        diagonal = np.where(is_feature, np.maximum(diagonal - of_one**2 / count, PENALTY), 1.0)
        right = np.where(is_feature, of_target - of_one * mean, 0.0)
        weights, settled = solve(product, diagonal, right, rounds)
        weights[0] = mean - of_one @ np.where(is_feature, weights, 0.0) / count
        kept = is_feature | (column == _ONE)
        return pd.DataFrame(
            {"company": entries["company"].iloc[0], "column": column[kept], "slot": names["s"].to_numpy()[kept], "weight": weights[kept], "settled": settled}
        )

    return of_company


def ridge_weights(encoded: Encoded, rounds: int = ROUNDS) -> DataFrame:
    """company, feature (a number or a text; null for the intercept), slot (of a text, else 0),
    weight, and whether the company's fit settled.

    A company's equations are one group: they grow with its pairs of categories that occur
    together, not with its lines.
    """
    weights = keep(equations(encoded).groupBy("company").applyInPandas(_weights_of(rounds), _WEIGHT), "ridge_weights")
    names = F.array(*[F.lit(c) for c in [*encoded.numbers, *encoded.texts]])
    return weights.select(
        "company", F.when(F.col("column") >= _FIRST, names[F.col("column") - _FIRST]).alias("feature"), "slot", "weight", "settled"
    )


def predicted(lines: DataFrame, encoded: Encoded, weights: DataFrame) -> DataFrame:
    """Adds ``prediction``. Categories without a slot, and features without a weight, add nothing."""
    number = lambda c: F.coalesce(F.max(F.when(F.col("feature").eqNullSafe(F.lit(c)), F.col("weight"))), F.lit(0.0))
    dense = weights.groupBy("company").agg(
        number(None).alias("intercept__weight"), *[number(c).alias(f"{c}__weight") for c in encoded.numbers]
    )
    lines = lines.join(dense, "company")
    prediction = F.col("intercept__weight")
    for c in encoded.numbers:
        prediction = prediction + F.col(f"{c}_scaled") * F.col(f"{c}__weight")
    for c in encoded.texts:
        of_text = weights.where(F.col("feature") == c).select("company", F.col("slot").alias(f"{c}_slot"), F.col("weight").alias(f"{c}__weight"))
        lines = lines.join(of_text, ["company", f"{c}_slot"], "left")
        prediction = prediction + F.coalesce(f"{c}__weight", F.lit(0.0))
    added = ["intercept__weight", *[f"{c}__weight" for c in [*encoded.numbers, *encoded.texts]]]
    return lines.withColumn("prediction", prediction).drop(*added)
