"""Ratios, means and the one rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL, not an error, on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean(value: Column) -> Column:
    """Aggregate mean that skips NULL and keeps the sum exact for decimals.

    ``avg`` over a decimal rounds to six places before the caller sees it.
    """
    return ratio(F.sum(value), F.count(value))


def rounded(value: Column, places: int) -> Column:
    """Round a double half-up at the report edge.

    Going through a decimal makes ties independent of how the binary double
    happens to be stored.
    """
    return F.round(value.cast("decimal(28,9)"), places).cast("double")


def rounded_sql(name: str, places: int) -> str:
    """The same rule as SQL text, for wide results."""
    return f"cast(round(cast(`{name}` as decimal(28,9)), {places}) as double)"
