"""Calendar dimension and calendar-aware comparisons over monthly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_of_month, ratio


def date_dimension(df: DataFrame, moment: str) -> DataFrame:
    """One row per day, padded to whole years around the dates in ``moment``."""
    span = df.agg(F.min(moment).alias("first"), F.max(moment).alias("last"))
    first = F.make_date(F.year("first"), F.lit(1), F.lit(1))
    last = F.make_date(F.year("last"), F.lit(12), F.lit(31))
    days = span.where(F.col("first").isNotNull()).select(F.explode(F.sequence(first, last)).alias("date"))
    return days.select("date", *[c.alias(n) for n, c in calendar_attributes(F.col("date")).items()])


def calendar_attributes(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date),
        "month_no": F.month(date),
        "month_name": F.date_format(date, "MMM"),
        "year_month": F.date_format(date, "yyyy-MM"),
        "quarter": F.concat(F.lit("Q"), F.quarter(date)),
        "month_start": first_of_month(date),
    }


def fill_months(df: DataFrame, month: str, dims: Sequence[str] = ()) -> DataFrame:
    """Add the calendar months missing between the first and last of each group.

    Added rows carry NULL in every measure.
    """
    dims = list(dims)
    span = df.groupBy(*dims).agg(F.min(month).alias("_first"), F.max(month).alias("_last"))
    months = F.explode(F.sequence(F.col("_first"), F.col("_last"), F.expr("interval 1 month")))
    spine = span.where(F.col("_first").isNotNull()).select(
        *[F.col(d).alias(f"_s_{d}") for d in dims], months.alias(f"_s_{month}")
    )
    same = F.lit(True)
    for name in [*dims, month]:
        same = same & F.col(f"_s_{name}").eqNullSafe(F.col(name))
    measures = [c for c in df.columns if c != month and c not in dims]
    return spine.join(df, same, "left").select(
        *[F.col(f"_s_{name}").alias(name) for name in [*dims, month]], *measures
    )


def prior_month(month: str, value: str, dims: Sequence[str] = ()) -> Column:
    """The value one calendar month earlier, NULL when that month has no row.

    The window holds one row per month of a group of an already aggregated
    table, so it is bounded by the length of the calendar.
    """
    w = Window.partitionBy(*dims).orderBy(month)
    adjacent = F.lag(month).over(w) == F.add_months(F.col(month), -1)
    return F.when(adjacent, F.lag(value).over(w))


def month_over_month(df: DataFrame, month: str, value: str, dims: Sequence[str] = ()) -> DataFrame:
    """Add the prior calendar month's value and the relative change to it."""
    out = df.withColumn(f"prior_{value}", prior_month(month, value, dims))
    change = ratio(F.col(value) - F.col(f"prior_{value}"), F.col(f"prior_{value}"))
    return out.withColumn(f"{value}_mom", change)


def year_to_date(df: DataFrame, month: str, value: str, dims: Sequence[str] = ()) -> DataFrame:
    """Add the running total since January; at most twelve rows per window."""
    w = (
        Window.partitionBy(*dims, F.year(month))
        .orderBy(month)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(f"{value}_ytd", F.sum(value).over(w))
