"""The five report tables and the headline derived a second way."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BUCKET_LABELS, is_late, mean, ratio, rounded, whole_days_late
from ..operators.populations import delivered_rows, is_cancelled, sales_rows
from ..operators.shares import with_place
from ..sources.readers import RawTables
from .marts import DELIVERED_AT, delivered_by_order, reviews_by_order


def _money(value: str) -> Column:
    return F.sum(value).alias("revenue")


def _late_rate() -> Column:
    """Mean of a nullable flag: rows without an outcome are in neither part."""
    return mean(F.col("is_late").cast("int"))


def _star_share(score: int) -> Column:
    """Share of all rows with this score; an unreviewed row counts below the line."""
    return mean(F.when(F.col("review_score") == score, 1.0).otherwise(0.0))


def monthly_sales(fct_order: DataFrame) -> DataFrame:
    """``aov`` here averages orders that have a value; see the metric ``aov`` for the ratio.

    Months are worked out of the fact collapsed to month and customer, so that
    counting customers exactly takes no second pass of the fact.
    """
    customers = sales_rows(fct_order).groupBy("order_month", "customer_unique_id").agg(
        F.count("*").alias("_orders"), F.sum("order_value").alias("_value"), F.count("order_value").alias("_valued")
    )
    return customers.groupBy("order_month").agg(
        F.sum("_orders").alias("orders"),
        _money("_value"),
        rounded(ratio(F.sum("_value"), F.sum("_valued")), 2).alias("aov"),
        F.count("customer_unique_id").alias("customers"),
    )


def category_performance(fct_order_item: DataFrame) -> DataFrame:
    return (
        sales_rows(fct_order_item)
        .groupBy("product_category")
        .agg(
            F.count("*").alias("items"),
            _money("item_value"),
            rounded(mean(F.col("price")), 3).alias("avg_price"),
            rounded(mean(F.col("freight_value")), 3).alias("avg_freight"),
            rounded(mean(F.col("review_score")), 3).alias("avg_review"),
            rounded(_late_rate(), 3).alias("late_rate"),
        )
    )


def bucket_spine(df: DataFrame) -> DataFrame:
    """All delivery buckets with their order; one small row set, no input rows."""
    rows = [
        F.struct(F.lit(label).alias("delivery_bucket"), F.lit(i).alias("bucket_ord"))
        for i, label in enumerate(BUCKET_LABELS, 1)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def delivery_vs_review(fct_order: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Orders, score and revenue per bucket; empty buckets show zero orders."""
    found = (
        delivered_rows(fct_order)
        .groupBy("delivery_bucket")
        .agg(
            F.count("*").alias("orders"),
            rounded(mean(F.col("review_score")), 3).alias("avg_review"),
            _money("order_value"),
        )
    )
    # A delivered order without a promise has no bucket; its row stays too.
    out = found.join(bucket_spine(fct_order), "delivery_bucket", "full" if keep_empty else "left")
    return out.select(
        "delivery_bucket", "bucket_ord", F.coalesce("orders", F.lit(0)).alias("orders"), "avg_review", "revenue"
    )


def state_performance(fct_order: DataFrame) -> DataFrame:
    return (
        delivered_rows(fct_order)
        .groupBy("customer_state")
        .agg(
            F.count("*").alias("orders"),
            _money("order_value"),
            rounded(mean(F.col("delivery_days")), 3).alias("avg_delivery_days"),
            rounded(_late_rate(), 3).alias("late_rate"),
            rounded(mean(F.col("review_score")), 3).alias("avg_review"),
        )
    )


def _lateness_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("is_late").agg(
        F.count("*").alias("orders"),
        rounded(mean(F.col("review_score")), 3).alias("avg_review"),
        rounded(_star_share(1), 3).alias("pct_1_star"),
        rounded(_star_share(5), 3).alias("pct_5_star"),
    )


def review_by_lateness(fct_order: DataFrame) -> DataFrame:
    return _lateness_table(delivered_rows(fct_order))


def headline_from_raw(raw: RawTables) -> DataFrame:
    """The same table from the raw inputs, without the marts, to check them."""
    orders = raw.orders.where(~is_cancelled(F.col("order_status"), raw.cancelled_statuses))
    if raw.line_delivered is not None:
        orders = orders.join(delivered_by_order(raw), "order_id", "left")
    rows = orders.where(F.col(DELIVERED_AT).isNotNull()).join(
        reviews_by_order(raw.order_reviews, ["review_score"]), "order_id", "left"
    )
    late = is_late(whole_days_late(F.col(DELIVERED_AT), F.col("order_estimated_delivery_date")))
    return _lateness_table(rows.select(late.alias("is_late"), "review_score"))


# How each report is ordered when it is written out; the key breaks ties.
REPORT_ORDER = {
    "monthly_sales": [(F.asc, "order_month")],
    "category_performance": [(F.desc, "revenue"), (F.asc, "product_category")],
    "delivery_vs_review": [(F.asc, "bucket_ord"), (F.asc, "delivery_bucket")],
    "state_performance": [(F.desc, "revenue"), (F.asc, "customer_state")],
    "review_by_lateness": [(F.asc, "is_late")],
}


def report_tables(fct_order: DataFrame, fct_order_item: DataFrame) -> dict[str, DataFrame]:
    """All five reports, in their published order."""
    built = {
        "monthly_sales": monthly_sales(fct_order),
        "category_performance": category_performance(fct_order_item),
        "delivery_vs_review": delivery_vs_review(fct_order),
        "state_performance": state_performance(fct_order),
        "review_by_lateness": review_by_lateness(fct_order),
    }
    return {name: in_report_order(name, df) for name, df in built.items()}


def _order_of(name: str) -> list[Column]:
    return [direction(column) for direction, column in REPORT_ORDER[name]]


def in_report_order(name: str, df: DataFrame) -> DataFrame:
    return df.orderBy(*_order_of(name))


def places(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(report, place, row_key) of every row of the reports in their written order."""
    parts = []
    for name, df in tables.items():
        key = F.col(REPORT_ORDER[name][-1][1]).cast("string").alias("row_key")
        parts.append(with_place(df, *_order_of(name)).select(F.lit(name).alias("report"), "place", key))
    return reduce(DataFrame.unionByName, parts)
