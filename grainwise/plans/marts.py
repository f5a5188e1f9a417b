"""Order fact, item fact and dimensions.

Every child is collapsed to one row per order before it meets the orders, so
each join below is one to one or many to one and no total can be inflated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import category_label, delivery_columns, first_of_month
from ..functions.labels import UNKNOWN_CATEGORY
from ..operators.grain import collapse, keep_latest, top_by
from ..operators.joins import join_many_to_one
from ..operators.populations import is_cancelled
from ..sources.readers import RawTables

DELIVERED_AT = "order_delivered_customer_date"

# The columns of the published marts, in their order.
CUSTOMER_COLUMNS = ("customer_unique_id", "customer_state", "customer_city")

ORDER_COLUMNS = (
    "order_id", "customer_id", "customer_unique_id", "customer_state", "customer_city",
    "order_status", "is_cancelled", "is_delivered",
    "order_purchase_timestamp", "order_date", "order_month",
    "order_delivered_customer_date", "order_estimated_delivery_date",
    "delivery_days", "estimated_days", "delay_days", "is_late", "delivery_bucket",
    "item_count", "seller_count", "product_revenue", "freight_value", "order_value",
    "payment_value", "payment_splits", "max_installments", "primary_payment_type",
    "review_score",
)

# Filled from the collapsed item lines.
ITEM_TOTALS = ("item_count", "seller_count", "product_revenue", "freight_value", "order_value")

# What an item line takes over from its order.
ORDER_ATTRIBUTES = (
    "customer_state", "order_status", "is_cancelled", "is_delivered",
    "order_purchase_timestamp", "order_month", "delivery_days", "delay_days",
    "is_late", "delivery_bucket", "review_score",
)

PRODUCT_COLUMNS = ("product_category", "product_weight_g")

ITEM_COLUMNS = (
    "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
    *PRODUCT_COLUMNS, "price", "freight_value", "item_value", *ORDER_ATTRIBUTES,
)


def items_by_order(raw: RawTables, columns: Sequence[str] = ITEM_TOTALS) -> DataFrame:
    """The requested totals of each order's lines, and its delivery where lines hold it."""
    totals = {
        "item_count": F.count("*"),
        "seller_count": F.countDistinct("seller_id"),
        "product_revenue": F.sum("price"),
        "freight_value": F.sum("freight_value"),
        "order_value": F.sum(F.col("price") + F.col("freight_value")),
    }
    chosen = {name: totals[name] for name in columns}
    if raw.line_delivered is not None:
        chosen[DELIVERED_AT] = F.max(raw.line_delivered)
    # The distinct count is worked out by order and seller first, and each step combines
    # on the map side: an order of any size reaches a task as one row per seller and task.
    return collapse(raw.order_items, "order_id", chosen)


def delivered_by_order(raw: RawTables) -> DataFrame:
    """When each order was delivered, for sources that record it per line.

    Lines that were not delivered are filtered before the shuffle.
    """
    lines = raw.order_items.where(F.col(raw.line_delivered).isNotNull())
    return collapse(lines, "order_id", {DELIVERED_AT: F.max(raw.line_delivered)})


def payments_by_order(payments: DataFrame, key: str = "order_id") -> DataFrame:
    """Totals and the type that carried the most money, earliest split on a tie."""
    return collapse(
        payments,
        key,
        {
            "payment_value": F.sum("payment_value"),
            "payment_splits": F.count("*"),
            "max_installments": F.max("payment_installments"),
            "primary_payment_type": top_by(
                F.col("payment_type"), F.col("payment_value"), -F.col("payment_sequential")
            ),
        },
    )


def reviews_by_order(
    reviews: DataFrame, columns: Sequence[str] = ("review_score", "review_creation_date")
) -> DataFrame:
    """The latest answered review of each order; an unanswered one loses."""
    order = ["review_answer_timestamp", "review_creation_date", "review_id"]
    return keep_latest(reviews, "order_id", order, columns)


def build_fct_order(raw: RawTables, columns: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """One row per order with the requested columns.

    The collapsed children share the join key, so the orders are shuffled once
    for all of them, and the optimizer drops the children nobody asked for. It
    cannot know that customers are unique, so that join is left out here.
    """
    fact = raw.orders
    if set(columns) & set(CUSTOMER_COLUMNS):
        people = raw.customers.select("customer_id", *CUSTOMER_COLUMNS)
        fact = join_many_to_one(fact, people, "customer_id", "left", raw.hot("orders", "customer_id"))
    totals = [c for c in ITEM_TOTALS if c in columns]
    if totals:
        fact = fact.join(items_by_order(raw, totals), "order_id", "left")
    elif raw.line_delivered is not None:
        fact = fact.join(delivered_by_order(raw), "order_id", "left")
    fact = (
        fact.join(payments_by_order(raw.order_payments), "order_id", "left")
        .join(reviews_by_order(raw.order_reviews, ["review_score"]), "order_id", "left")
    )
    purchased = F.col("order_purchase_timestamp")
    derived = {
        "is_cancelled": is_cancelled(F.col("order_status"), raw.cancelled_statuses),
        "order_date": F.to_date(purchased),
        "order_month": first_of_month(purchased),
        **delivery_columns(purchased, F.col(DELIVERED_AT), F.col("order_estimated_delivery_date")),
    }
    return fact.withColumns(derived).select(*columns)


def build_dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    label = category_label(F.col("product_category_name_english"), F.col("product_category_name"))
    return products.join(translation, "product_category_name", "left").select(
        "product_id", label.alias("product_category"), "product_weight_g"
    )


def build_fct_order_item(
    raw: RawTables, columns: Sequence[str] = ITEM_COLUMNS, fct_order: DataFrame | None = None
) -> DataFrame:
    """One row per item line; the only grain at which categories may be summed.

    Pass a stored ``fct_order`` to avoid building the order side again.
    """
    attributes = [c for c in ORDER_ATTRIBUTES if c in columns]
    fact = raw.order_items.withColumn("item_value", F.col("price") + F.col("freight_value"))
    # Orders first: a filter on the order then thins out the lines that are
    # shuffled once more by product.
    if attributes:
        order = fct_order if fct_order is not None else build_fct_order(raw, ["order_id", *attributes])
        order = order.select("order_id", *attributes)
        fact = join_many_to_one(fact, order, "order_id", "inner", raw.hot("order_items", "order_id"))
    if set(columns) & set(PRODUCT_COLUMNS):
        products = build_dim_product(raw.products, raw.category_translation)
        fact = join_many_to_one(fact, products, "product_id", "left", raw.hot("order_items", "product_id"))
        fact = fact.withColumn("product_category", F.coalesce("product_category", F.lit(UNKNOWN_CATEGORY)))
    return fact.select(*columns)


def build_dim_customer(raw: RawTables) -> DataFrame:
    return raw.customers


def build_dim_seller(raw: RawTables) -> DataFrame:
    return raw.sellers
