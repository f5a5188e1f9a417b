"""Named row populations and slicers, so no query restates a filter inline."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses of orders that never became revenue.
CANCELLED_STATUSES = ("canceled", "unavailable")


def is_cancelled(status: Column, cancelled: Iterable[str] = CANCELLED_STATUSES) -> Column:
    """Never NULL: an order without a status is not a cancelled one."""
    return F.coalesce(status.isin(*cancelled), F.lit(False))


def sales() -> Column:
    return ~F.col("is_cancelled")


def delivered() -> Column:
    return sales() & F.col("is_delivered")


def reviewed() -> Column:
    return sales() & F.col("review_score").isNotNull()


def sales_rows(df: DataFrame) -> DataFrame:
    """The base table of every sales metric."""
    return df.where(sales())


def delivered_rows(df: DataFrame) -> DataFrame:
    """The base table of every delivery metric."""
    return df.where(delivered())


def reviewed_rows(df: DataFrame) -> DataFrame:
    """The base table of every review metric."""
    return df.where(reviewed())


def slice_rows(
    df: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    states: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    date_col: str = "order_purchase_timestamp",
) -> DataFrame:
    """Report slicers: a closed date range and two multi-selects.

    The range is written against the timestamp itself, not ``to_date`` of it,
    so it reaches the Parquet scan, and again against the month by which a
    stored fact is partitioned, so whole months are never opened.
    """
    by_month = date_col == "order_purchase_timestamp" and "order_month" in df.columns
    if date_from is not None:
        first = F.lit(date_from).cast("date")
        df = df.where(F.col(date_col) >= first.cast("timestamp_ntz"))
        if by_month:
            df = df.where(F.col("order_month") >= F.trunc(first, "MM"))
    if date_to is not None:
        last = F.lit(date_to).cast("date")
        df = df.where(F.col(date_col) < F.date_add(last, 1).cast("timestamp_ntz"))
        if by_month:
            df = df.where(F.col("order_month") <= last)
    if states is not None:
        df = df.where(F.col("customer_state").isin(*states))
    if categories is not None:
        df = df.where(F.col("product_category").isin(*categories))
    return df


def enough_volume(df: DataFrame, count_col: str, minimum: int, strict: bool = False) -> DataFrame:
    """Groups with enough rows to be read: ``>= minimum``, or ``>`` when strict."""
    return df.where(F.col(count_col) > minimum if strict else F.col(count_col) >= minimum)


def too_little_volume(df: DataFrame, count_col: str, minimum: int, strict: bool = False) -> DataFrame:
    """The complement of :func:`enough_volume`, to be shown beside it."""
    return df.where(F.col(count_col) <= minimum if strict else F.col(count_col) < minimum)
