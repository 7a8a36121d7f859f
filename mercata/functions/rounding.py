"""Exact decimal rounding of ratios and money handling.

Rounding a double ratio (``round(a / b, 2)``) is not portable: engines
disagree on halves that are not exactly representable. Reports here round
ratios of integers exactly, half away from zero (the SQL NUMERIC rule), in
decimal(38,0) arithmetic, and only then turn the result into a double.
Money is carried as integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _exact_div(a: Column, b: Column) -> Column:
    """floor(a / b) for a >= 0, b > 0, without any decimal-division rounding."""
    return (a - a % b) / b


def round_ratio_units(num: Column, den: Column, scale: int) -> Column:
    """round(num / den, scale) * 10**scale as an exact integer (decimal(38,0)).

    Half away from zero. NULL when ``den`` is 0 or NULL.
    """
    n = num.cast(WIDE)
    d = F.nullif(den.cast(WIDE), F.lit(0).cast(WIDE))
    abs_d = F.abs(d)
    q = _exact_div(F.abs(n) * F.lit(2 * 10**scale) + abs_d, abs_d * F.lit(2)).cast(WIDE)
    return F.when((n < 0) != (d < 0), -q).otherwise(q)


def units_to_double(units: Column, scale: int) -> Column:
    return units.cast("double") / F.lit(float(10**scale))


def round_ratio(num: Column, den: Column, scale: int) -> Column:
    """round(num / den, scale) as a double, computed exactly."""
    return units_to_double(round_ratio_units(num, den, scale), scale)


def to_cents(amount: Column) -> Column:
    """Decimal money amount -> bigint cents (exact for 2-decimal prices)."""
    return (amount.cast("decimal(20,2)") * F.lit(100)).cast("bigint")


def cents_to_money(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def int_div(a: Column, b: Column) -> Column:
    """Integer floor division of non-negative integers (SQL ``a div b``)."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")
