"""Column expressions: exact sums, guarded ratios, clipping and rounding.

Every function takes and returns a Spark ``Column`` and stays inside built-in
expressions, so Catalyst can fold, prune and generate code for all of them.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

# Amounts and quantities are summed as fixed-point numbers. Adding doubles in a
# different order changes the last digits, and the order of partial sums differs
# from run to run on a cluster. Turning every double into a decimal would be slow,
# so each is split into whole units and millionths, which are summed as integers
# and put together once per group.
AMOUNT = "decimal(28,6)"
MILLION = 1e6
MILLIONTH = Decimal("0.000001")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def amount(value: Column | str) -> Column:
    """A quantity or an amount of money as a fixed-point number."""
    return _column(value).cast(AMOUNT)


def units(value: Column | str) -> Column:
    """The whole units of a double."""
    return F.floor(_column(value)).cast("bigint")


def millionths(value: Column | str) -> Column:
    """What ``units`` leaves, in millionths."""
    column = _column(value)
    return F.rint((column - F.floor(column)) * MILLION).cast("bigint")


def residue(value: Column | str) -> Column:
    """What units and millionths leave, unless it is below the double's own precision."""
    column = _column(value)
    left = column - F.floor(column) - F.rint((column - F.floor(column)) * MILLION) / MILLION
    return F.when(F.abs(left) > F.abs(column) * 4e-16, left).otherwise(0.0)


def exact_sum(value: Column | str) -> Column:
    """Sum of doubles; 0 for a group without any value.

    Units and millionths are summed as integers. What lies below them is summed as it
    is: its order of summation changes digits far below those of the result.
    """
    whole = F.sum(units(value)).cast("decimal(20,0)")
    parts = F.sum(millionths(value)).cast("decimal(20,0)")
    rest = F.sum(residue(value)).cast("decimal(38,18)")
    total = whole + parts * F.lit(MILLIONTH) + rest
    return F.coalesce(total.cast("decimal(38,17)"), F.lit(0).cast("decimal(38,17)"))


def exact_ratio_sum(value: Column | str) -> Column:
    """Sum of doubles with twelve decimals, for ratios."""
    column = _column(value)
    fine = (column - F.floor(column)) * MILLION
    whole = F.sum(units(column)).cast("decimal(25,0)")
    parts = F.sum(units(fine)).cast("decimal(20,0)")
    finest = F.sum(millionths(fine)).cast("decimal(20,0)")
    return (whole + parts * F.lit(MILLIONTH) + finest * F.lit(MILLIONTH**2)).cast("decimal(38,12)")


def exact_mean(value: Column | str) -> Column:
    """Mean of the non-null values as a double; null for a group without any."""
    return F.try_divide(exact_sum(value).cast("double"), F.count(_column(value)).cast("double"))


def guarded_ratio(numerator: Column | str, divisor: Column | str) -> Column:
    """``numerator / divisor``, and 0 where the divisor is 0."""
    numerator, divisor = _column(numerator).cast("double"), _column(divisor).cast("double")
    return F.when(divisor != 0, numerator / divisor).otherwise(F.lit(0.0))


def at_least_zero(value: Column | str) -> Column:
    """Clip below at 0; null stays null."""
    column = _column(value)
    return F.when(column.isNotNull(), F.greatest(column, F.lit(0.0)))


def whole_units(value: Column | str) -> Column:
    """Clip below at 0 and cut the fraction off."""
    return at_least_zero(value).cast("bigint")


def round_half_even(value: Column | str, digits: int) -> Column:
    """Round the scaled double, ties to even.

    ``bround`` rounds the printed decimal instead, which differs where the
    double lies just beside a tie.
    """
    scale = float(10**digits)
    return F.rint(_column(value) * scale) / scale
