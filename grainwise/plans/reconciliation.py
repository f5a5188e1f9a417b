"""Do the marts still say what the raw tables say?"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..operators.checks import Check, compare_tables, run_checks
from ..operators.constraints import constraint_report, orphan_keys
from ..operators.fanout import Child, fanout_report
from ..operators.populations import sales_rows
from ..operators.totals import merge_totals
from ..schemas import RULES
from ..sources.readers import RawTables
from .metrics import evaluate
from .raw_sql import REPORTS, report_from_raw
from .reports import review_by_lateness


def reconciliation_totals(raw: RawTables, fct_order: DataFrame, fct_order_item: DataFrame) -> DataFrame:
    """One row with every total the checks compare.

    The order fact is collapsed to its ids first, so that its rows and its distinct
    ids come from one pass.
    """
    per_order = fct_order.groupBy("order_id").agg(
        F.count("*").alias("_rows"),
        F.sum("product_revenue").alias("_revenue"),
        F.sum("order_value").alias("_value"),
        F.count_if(F.col("payment_value").isNull()).alias("_unpaid"),
    )
    return merge_totals(
        raw.orders.agg(F.count("*").alias("raw_orders")),
        raw.order_items.agg(
            F.count("*").alias("raw_items"),
            F.sum("price").alias("raw_product_revenue"),
        ),
        raw.order_payments.agg(F.sum("payment_value").alias("raw_payment_value")),
        per_order.agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("fct_orders"),
            F.count("order_id").alias("fct_order_ids"),
            F.sum("_revenue").alias("fct_product_revenue"),
            F.sum("_value").alias("fct_order_value"),
            F.coalesce(F.sum("_unpaid"), F.lit(0)).alias("orders_without_payment"),
        ),
        fct_order_item.agg(F.count("*").alias("fct_items"), F.sum("item_value").alias("fct_item_value")),
    )


def reconciliation_checks(
    payment_gap: float | None = None, unpaid_orders: int | None = None, unpaid_share: float | None = None
) -> list[Check]:
    """The six checks. The last two are known gaps; the arguments bound them, unpaid orders by number or share."""
    gap = ratio(F.col("raw_payment_value"), F.col("fct_order_value")) - 1
    unpaid = [F.col("orders_without_payment") <= unpaid_orders] if unpaid_orders is not None else []
    if unpaid_share is not None:
        unpaid.append(F.col("orders_without_payment") <= F.col("raw_orders") * F.lit(unpaid_share))

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    # The published names of the checks.
    return [
        Check(
            "fct_order is one row per order",
            F.col("raw_orders"),
            F.col("fct_orders"),
            same("fct_orders", "fct_order_ids") & same("fct_orders", "raw_orders"),
            "Items or payments joined before they were collapsed would show up here.",
        ),
        Check(
            "fct_order_item preserves every item line",
            F.col("raw_items"),
            F.col("fct_items"),
            same("fct_items", "raw_items"),
            "The join to the orders may neither drop nor repeat a line.",
        ),
        Check(
            "product revenue ties to raw item prices",
            F.col("raw_product_revenue"),
            F.col("fct_product_revenue"),
            same("fct_product_revenue", "raw_product_revenue"),
            "Revenue at order grain is the sum of the raw prices.",
        ),
        Check(
            "order value ties to item grain",
            F.col("fct_item_value"),
            F.col("fct_order_value"),
            same("fct_order_value", "fct_item_value"),
            "Both facts hold the same total value.",
        ),
        Check(
            "payments equal order value",
            F.col("fct_order_value"),
            F.col("raw_payment_value"),
            same("raw_payment_value", "fct_order_value"),
            F.concat(
                F.lit("Payments differ from item value by "),
                F.coalesce(F.format_string("%.2f", gap * 100), F.lit("an unknown")),
                F.lit("%: interest and vouchers are paid but are not item revenue."),
            ),
            known_gap=True,
            gap_bound=None if payment_gap is None else F.abs(gap) <= payment_gap,
        ),
        Check(
            "every order has a payment row",
            F.lit(0),
            F.col("orders_without_payment"),
            F.col("orders_without_payment") == 0,
            "Missing upstream and left NULL, so payment measures skip the order.",
            known_gap=True,
            gap_bound=reduce(Column.__and__, unpaid) if unpaid else None,
        ),
    ]


def reconcile(
    raw: RawTables,
    fct_order: DataFrame,
    fct_order_item: DataFrame,
    payment_gap: float | None = None,
    unpaid_orders: int | None = None,
    unpaid_share: float | None = None,
) -> DataFrame:
    totals = reconciliation_totals(raw, fct_order, fct_order_item)
    return run_checks(totals, reconciliation_checks(payment_gap, unpaid_orders, unpaid_share))


def order_fanout(raw: RawTables) -> DataFrame:
    """What joining orders, items and payments directly would claim."""
    return fanout_report(
        raw.orders,
        "order_id",
        {
            "revenue": Child(raw.order_items, "order_id", F.col("price") + F.col("freight_value")),
            "payments": Child(raw.order_payments, "order_id", F.col("payment_value")),
        },
    )


def additivity(fct_order: DataFrame, fct_order_item: DataFrame) -> DataFrame:
    """Category revenues summed up, beside total revenue at order grain."""
    by_category = evaluate(sales_rows(fct_order_item), ["category_revenue"], ["product_category"])
    totals = merge_totals(
        by_category.agg(
            F.count("*").alias("categories"), F.sum("category_revenue").alias("sum_of_categories")
        ),
        evaluate(fct_order, ["total_revenue"]),
    )
    return totals.withColumn("additive", F.col("sum_of_categories").eqNullSafe(F.col("total_revenue")))


def compare_report(raw: RawTables, name: str, report: DataFrame) -> DataFrame:
    """A report from the marts against the same from SQL over the raw tables, which shares no code with it."""
    key, _ = REPORTS[name]
    other = report_from_raw(raw, name)
    return compare_tables(report, other, key, [c for c in other.columns if c != key])


def compare_headline(raw: RawTables, fct_order: DataFrame) -> DataFrame:
    """The lateness report from the marts against the raw tables."""
    return compare_report(raw, "review_by_lateness", review_by_lateness(fct_order))


def comparisons(raw: RawTables, reports: Mapping[str, DataFrame]) -> DataFrame:
    """All reports compared, one row per report and column."""
    parts = [compare_report(raw, name, df).select(F.lit(name).alias("report"), "*") for name, df in reports.items()]
    return reduce(DataFrame.unionByName, parts)


def orders_without_review(raw: RawTables) -> DataFrame:
    """Review coverage over all orders, from the raw tables."""
    missing = orphan_keys(raw.orders, "order_id", raw.order_reviews, "order_id")
    totals = merge_totals(
        raw.orders.agg(F.count("*").alias("orders")),
        missing.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("orders_without_review")),
    )
    covered = ratio(F.col("orders") - F.col("orders_without_review"), F.col("orders"))
    return totals.withColumn("coverage", covered)


def raw_constraints(raw: RawTables) -> DataFrame:
    """Every declared key, reference and domain of the raw tables."""
    return constraint_report(raw.by_name(), RULES)
