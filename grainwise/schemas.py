"""Raw tables: column types, keys and promises."""

from __future__ import annotations

from pyspark.sql import types as T

from .operators.constraints import ForeignKey, TableRules

_S, _I, _D, _N = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()
_MONEY = T.DecimalType(12, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


# Names and types of the published raw tables.
SCHEMAS: dict[str, T.StructType] = {
    "customers": _table(
        customer_id=_S,
        customer_unique_id=_S,
        customer_zip_code_prefix=_S,
        customer_city=_S,
        customer_state=_S,
    ),
    "sellers": _table(seller_id=_S, seller_zip_code_prefix=_S, seller_city=_S, seller_state=_S),
    "product_category_translation": _table(product_category_name=_S, product_category_name_english=_S),
    # "lenght" is how the published files spell it.
    "products": _table(
        product_id=_S,
        product_category_name=_S,
        product_name_lenght=_I,
        product_description_lenght=_I,
        product_photos_qty=_I,
        product_weight_g=_D,
        product_length_cm=_D,
        product_height_cm=_D,
        product_width_cm=_D,
    ),
    "orders": _table(
        order_id=_S,
        customer_id=_S,
        order_status=_S,
        order_purchase_timestamp=_N,
        order_approved_at=_N,
        order_delivered_carrier_date=_N,
        order_delivered_customer_date=_N,
        order_estimated_delivery_date=_N,
    ),
    "order_items": _table(
        order_id=_S,
        order_item_id=_I,
        product_id=_S,
        seller_id=_S,
        shipping_limit_date=_N,
        price=_MONEY,
        freight_value=_MONEY,
    ),
    "order_payments": _table(
        order_id=_S,
        payment_sequential=_I,
        payment_type=_S,
        payment_installments=_I,
        payment_value=_MONEY,
    ),
    "order_reviews": _table(
        review_id=_S,
        order_id=_S,
        review_score=T.ShortType(),
        review_comment_title=_S,
        review_comment_message=_S,
        review_creation_date=_N,
        review_answer_timestamp=_N,
    ),
}

# Free text may hold line breaks, which costs the reader its file splitting.
MULTILINE_TABLES = frozenset({"order_reviews"})

# Review text is the bulk of its file and no measure uses it.
TRIMMED_COLUMNS = {"order_reviews": ("review_comment_title", "review_comment_message")}

# Reviews have no key on purpose: duplicates are reported, not rejected.
RULES: dict[str, TableRules] = {
    "customers": TableRules(key=("customer_id",), not_null=("customer_unique_id",)),
    "sellers": TableRules(key=("seller_id",)),
    "product_category_translation": TableRules(key=("product_category_name",)),
    "products": TableRules(key=("product_id",)),
    "orders": TableRules(
        key=("order_id",),
        foreign_keys=(ForeignKey("customer_id", "customers", "customer_id"),),
        not_null=("customer_id", "order_status", "order_purchase_timestamp", "order_estimated_delivery_date"),
    ),
    "order_items": TableRules(
        key=("order_id", "order_item_id"),
        foreign_keys=(
            ForeignKey("order_id", "orders", "order_id"),
            ForeignKey("product_id", "products", "product_id"),
            ForeignKey("seller_id", "sellers", "seller_id"),
        ),
        not_null=("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
    ),
    "order_payments": TableRules(
        key=("order_id", "payment_sequential"),
        foreign_keys=(ForeignKey("order_id", "orders", "order_id"),),
        not_null=("order_id", "payment_sequential"),
    ),
    "order_reviews": TableRules(not_null=("order_id",), between={"review_score": (1, 5)}),
}
