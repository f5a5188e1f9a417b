"""Shares, ranks and steps over already aggregated tables.

Totals come from a scalar subquery and not from a window over the whole
table, so no task ever holds all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def total_of(df: DataFrame, value: str) -> Column:
    return df.agg(F.sum(value)).scalar()


def share_of_total(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{value}_share", ratio(F.col(value), total_of(df, value)))


def scaled_to_max(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """The value relative to the largest one."""
    return df.withColumn(name or f"{value}_scaled", ratio(F.col(value), df.agg(F.max(value)).scalar()))


def top_n(df: DataFrame, value: str, tiebreak: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest value, ties in ``tiebreak`` order."""
    return df.orderBy(F.desc_nulls_last(value), F.asc(tiebreak)).limit(n)


def cumulative_share(df: DataFrame, value: str, tiebreak: str, n: int) -> DataFrame:
    """Rank, share and running share of the ``n`` largest groups.

    The window sees ``n`` rows; the total still covers every group.
    """
    w = Window.orderBy(F.desc_nulls_last(value), F.asc(tiebreak))
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = total_of(df, value)
    return top_n(df, value, tiebreak, n).select(
        "*",
        F.row_number().over(w).alias("rank"),
        ratio(F.col(value), total).alias("share"),
        ratio(running, total).alias("cumulative_share"),
    )


def step_change(df: DataFrame, order: str, value: str, name: str | None = None) -> DataFrame:
    """Difference to the row before, over a short ordinal scale such as buckets."""
    return df.withColumn(name or f"{value}_step", F.col(value) - F.lag(value).over(Window.orderBy(order)))


def with_place(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``place``, the row's number in the given order, which must break every tie.

    For written reports and check tables, whose rows are as many as their
    groups: one task sorts them all.
    """
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
