"""Adapter: the benchmark star tables in the roles of the raw tables.

orders, lineitem, customer, supplier and part play orders, item lines,
customers, sellers and products. A line also is the split that pays for it, with
interest for instalments, and lines that were not returned are reviewed, those
delivered with an answer. So an order may have several reviews, unanswered ones or
none, and its payments exceed its value by a little. Events of a user are the splits
of a second parent. README.md lists the mapping.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import RawTables

STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}
STAR_CANCELLED = ("P",)
PROMISE_DAYS = 60


def star_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).parquet(f"{root}/{name}.parquet") for name, s in STAR_SCHEMAS.items()}


def _money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def _items(lineitem: DataFrame) -> DataFrame:
    price = _money(F.col("l_extendedprice"))
    freight = F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2)
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        _money(freight).alias("freight_value"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("line_delivered_at"),
    )


def _orders(orders: DataFrame) -> DataFrame:
    purchased = F.col("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        purchased.alias("order_purchase_timestamp"),
        (purchased + F.expr(f"interval {PROMISE_DAYS} days")).alias("order_estimated_delivery_date"),
    )


def _installments(quantity: Column) -> Column:
    return (F.floor(quantity / 10) + 1).cast("int")


def _payments(lineitem: DataFrame) -> DataFrame:
    """One split per line: its value and one percent of interest for every instalment after the first."""
    price = _money(F.col("l_extendedprice"))
    freight = _money(F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2))
    installments = _installments(F.col("l_quantity"))
    factor = ((installments + 99).cast("decimal(5,0)") * F.lit(Decimal("0.01"))).cast("decimal(4,2)")
    kind = F.when(F.col("l_returnflag") == "A", "credit").when(F.col("l_returnflag") == "N", "transfer").otherwise("voucher")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("payment_sequential"),
        kind.alias("payment_type"),
        installments.alias("payment_installments"),
        _money(F.round((price + freight) * factor, 2)).alias("payment_value"),
    )


def payments_of_users(events: DataFrame) -> DataFrame:
    """Events as the payment splits of customers."""
    return events.select(
        F.col("user_id").alias("customer_id"),
        F.col("event_id").alias("payment_sequential"),
        F.col("event_type").alias("payment_type"),
        (F.floor(F.col("value") / 100) + 1).cast("int").alias("payment_installments"),
        _money(F.col("value")).alias("payment_value"),
    )


def _reviews(lineitem: DataFrame) -> DataFrame:
    """Lines that were not returned are reviewed; those still open have no answer, and every 17th quantity no score."""
    quantity = F.col("l_quantity").cast("int")
    answered = F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber"))
    return lineitem.where(F.col("l_returnflag") != "R").select(
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        F.when(quantity % 17 != 0, quantity % 5 + 1).cast("smallint").alias("review_score"),
        F.col("l_shipdate").alias("review_creation_date"),
        F.when(F.col("l_linestatus") == "F", answered).alias("review_answer_timestamp"),
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    state = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_state"))
    return customer.join(state, "c_nationkey", "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        "customer_state",
    )


def _sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    state = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller_state"))
    return supplier.join(state, "s_nationkey", "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        "seller_state",
    )


def _products(part: DataFrame) -> DataFrame:
    # Parts of size 1 play the products without a category.
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") != 1, F.col("p_brand")).alias("product_category_name"),
        F.col("p_retailprice").alias("product_weight_g"),
    )


def _translation(nation: DataFrame, region: DataFrame) -> DataFrame:
    # One row per nation: Brand#0 to Brand#24, so Brand#25 stays untranslated.
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey")).alias("product_category_name"),
        F.concat_ws("_", F.replace(F.lower("r_name"), F.lit(" "), F.lit("_")), F.col("n_nationkey")).alias(
            "product_category_name_english"
        ),
    )


def load_star(spark: SparkSession, root: str) -> RawTables:
    t = star_tables(spark, root)
    return RawTables(
        orders=_orders(t["orders"]),
        order_items=_items(t["lineitem"]),
        order_payments=_payments(t["lineitem"]),
        order_reviews=_reviews(t["lineitem"]),
        customers=_customers(t["customer"], t["nation"]),
        sellers=_sellers(t["supplier"], t["nation"]),
        products=_products(t["part"]),
        category_translation=_translation(t["nation"], t["region"]),
        cancelled_statuses=STAR_CANCELLED,
        line_delivered="line_delivered_at",
    )
