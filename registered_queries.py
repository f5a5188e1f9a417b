"""Every query the driver runs, over the whole benchmark tables.

Each entry builds its plan from the tables in ``sf_dir``. Results are brought
to common types at the edge: decimals as doubles, whole numbers as bigints.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.functions import rounded
from grainwise.operators import constraints, fanout, grain, shares, totals
from grainwise.operators.calendar import date_dimension, fill_months
from grainwise.operators.constraints import ForeignKey, TableRules
from grainwise.operators.joins import with_dims
from grainwise.operators.populations import (
    delivered,
    delivered_rows,
    reviewed,
    reviewed_rows,
    sales,
    sales_rows,
    slice_rows,
)
from grainwise.plans import marts, metrics, pages, reports
from grainwise.plans import reconciliation as recon
from grainwise.sources.readers import RawTables
from grainwise.sources.star import load_star, payments_of_users, star_tables

Query = Callable[[SparkSession, str], DataFrame]

STAR_RULES = {
    "region": TableRules(key=("r_regionkey",), not_null=("r_name",)),
    "nation": TableRules(
        key=("n_nationkey",),
        foreign_keys=(ForeignKey("n_regionkey", "region", "r_regionkey"),),
        not_null=("n_name",),
    ),
    "customer": TableRules(
        key=("c_custkey",),
        foreign_keys=(ForeignKey("c_nationkey", "nation", "n_nationkey"),),
        not_null=("c_name", "c_nationkey"),
    ),
    "supplier": TableRules(
        key=("s_suppkey",), foreign_keys=(ForeignKey("s_nationkey", "nation", "n_nationkey"),)
    ),
    "part": TableRules(key=("p_partkey",), between={"p_size": (1, 50)}),
    "orders": TableRules(
        key=("o_orderkey",),
        foreign_keys=(ForeignKey("o_custkey", "customer", "c_custkey"),),
        not_null=("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"),
    ),
    "lineitem": TableRules(
        key=("l_orderkey", "l_linenumber"),
        foreign_keys=(
            ForeignKey("l_orderkey", "orders", "o_orderkey"),
            ForeignKey("l_partkey", "part", "p_partkey"),
            ForeignKey("l_suppkey", "supplier", "s_suppkey"),
        ),
        not_null=("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"),
        between={"l_linenumber": (1, 7), "l_discount": (0, 0.1)},
    ),
    "events": TableRules(
        key=("event_id",),
        foreign_keys=(ForeignKey("user_id", "customer", "c_custkey"),),
        not_null=("user_id", "ts"),
    ),
}

STATES = ("NATION_1", "NATION_2", "NATION_3", "NATION_7")
CATEGORIES = ("Asia 2", "Brand#25", "Unknown")
DATE_FROM, DATE_TO = "1996-07-01", "1998-06-30"


def to_edge(df: DataFrame) -> DataFrame:
    """Decimals as doubles and whole numbers as bigints, for the comparison."""
    edge = {"int": "bigint", "smallint": "bigint"}
    types = {n: "double" if t.startswith("decimal") else edge.get(t) for n, t in df.dtypes}
    return df.selectExpr(*[f"cast(`{n}` as {t}) as `{n}`" if t else f"`{n}`" for n, t in types.items()])


REGISTRY: dict[str, Query] = {}


# Tables are opened once a session and folder, as a job does that runs many queries over them.
@lru_cache(maxsize=4)
def _raw(spark: SparkSession, sf_dir: str) -> RawTables:
    return load_star(spark, sf_dir)


@lru_cache(maxsize=4)
def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return star_tables(spark, sf_dir)


def query(build: Callable[[RawTables], DataFrame]) -> Callable[[RawTables], DataFrame]:
    """Register a query over the tables in their roles."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_edge(build(_raw(spark, sf_dir)))

    REGISTRY[build.__name__] = run
    return build


def table_query(build: Callable[[dict[str, DataFrame]], DataFrame]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Register a query over the tables as they are."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_edge(build(_tables(spark, sf_dir)))

    REGISTRY[build.__name__] = run
    return build


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def _order(raw: RawTables, *columns: str) -> DataFrame:
    """The order fact with the columns asked for, or all that any metric uses."""
    return marts.build_fct_order(raw, columns or METRIC_COLUMNS)


# Enough for lateness and scores: no item totals, so undelivered lines stay unread.
LATENESS = ("is_cancelled", "is_delivered", "is_late", "review_score")
DURATIONS = (
    "is_cancelled", "is_delivered", "order_purchase_timestamp", marts.DELIVERED_AT,
    "delivery_days", "estimated_days",
)
# No metric uses the exact count of sellers, which has a shuffle of its own.
METRIC_COLUMNS = tuple(c for c in marts.ORDER_COLUMNS if c != "seller_count")
ORDER_ONLY = tuple(c for c in METRIC_COLUMNS if c not in marts.CUSTOMER_COLUMNS)
ITEM_ONLY = tuple(c for c in marts.ITEM_COLUMNS if c != "customer_state")


def _item(raw: RawTables, *columns: str) -> DataFrame:
    return marts.build_fct_order_item(raw, columns or ITEM_ONLY)


# marts and dimensions


@query
def fct_order(raw):
    return marts.build_fct_order(raw)


@query
def fct_order_item(raw):
    return marts.build_fct_order_item(raw)


@query
def dim_product(raw):
    return marts.build_dim_product(raw.products, raw.category_translation)


@query
def dim_customer(raw):
    return marts.build_dim_customer(raw)


@query
def dim_seller(raw):
    return marts.build_dim_seller(raw)


@query
def dim_date(raw):
    return date_dimension(raw.orders, "order_purchase_timestamp")


@query
def items_by_order(raw):
    return marts.items_by_order(raw)


@query
def payments_by_order(raw):
    """Collapsed payments on their orders; NULL where an order has none."""
    return raw.orders.select("order_id").join(marts.payments_by_order(raw.order_payments), "order_id", "left")


@table_query
def payments_by_parent(t):
    """A second parent: the splits of customers."""
    return marts.payments_by_order(payments_of_users(t["events"]), "customer_id")


@query
def reviews_by_order(raw):
    return marts.reviews_by_order(raw.order_reviews)


@table_query
def keep_latest(t):
    kept = ["event_id", "ts", "event_type", "value"]
    return grain.keep_latest(t["events"], "user_id", ["ts", "event_id"], kept)


@query
def delivery_columns(raw):
    return _order(raw, "order_id", "is_cancelled", "is_delivered", "order_date", "order_month",
                  "delivery_days", "estimated_days", "delay_days", "is_late", "delivery_bucket")


# reports


@query
def monthly_sales(raw):
    fact = _order(raw, "order_month", "is_cancelled", "order_value", "customer_unique_id")
    return reports.in_report_order("monthly_sales", reports.monthly_sales(fact))


@query
def category_performance(raw):
    return reports.in_report_order("category_performance", reports.category_performance(_item(raw)))


@query
def delivery_vs_review(raw):
    return reports.in_report_order("delivery_vs_review", reports.delivery_vs_review(_order(raw, *ORDER_ONLY)))


@query
def state_performance(raw):
    return reports.in_report_order("state_performance", reports.state_performance(_order(raw)))


@query
def review_by_lateness(raw):
    return reports.in_report_order("review_by_lateness", reports.review_by_lateness(_order(raw, *LATENESS)))


@query
def headline_from_raw(raw):
    return reports.headline_from_raw(raw)


# metrics


@query
def metrics_total(raw):
    return metrics.at_edge(metrics.evaluate(_order(raw), metrics.ORDER_METRICS))


@query
def metrics_by_state(raw):
    return metrics.at_edge(metrics.evaluate(_order(raw), metrics.ORDER_METRICS, ["customer_state"]))


@query
def metrics_by_month(raw):
    return metrics.at_edge(metrics.evaluate(_order(raw), metrics.ORDER_METRICS, ["order_month"]))


@query
def item_metrics_total(raw):
    return metrics.at_edge(metrics.evaluate(_item(raw), metrics.ITEM_METRICS))


@query
def item_metrics_by_category(raw):
    return metrics.at_edge(metrics.evaluate(_item(raw), metrics.ITEM_METRICS, ["product_category"]))


METRIC_SAMPLE = ("total_revenue", "total_orders", "total_customers", "aov", "late_delivery_rate", "one_star_rate")


@query
def metrics_rollup(raw):
    return metrics.at_edge(
        metrics.evaluate(_order(raw), METRIC_SAMPLE, ["order_status", "customer_state"], "rollup")
    )


@query
def metrics_cube(raw):
    return metrics.at_edge(
        metrics.evaluate(_order(raw), METRIC_SAMPLE, ["delivery_bucket", "customer_city"], "cube")
    )


@query
def slice_metrics(raw):
    fact = slice_rows(_order(raw), DATE_FROM, DATE_TO, STATES)
    return metrics.at_edge(metrics.evaluate(fact, metrics.ORDER_METRICS, ["customer_state"]))


@query
def slice_item_metrics(raw):
    fact = slice_rows(marts.build_fct_order_item(raw), DATE_FROM, DATE_TO, STATES, CATEGORIES)
    return metrics.at_edge(metrics.evaluate(fact, metrics.ITEM_METRICS, ["product_category"]))


@query
def metrics_by_dims(raw):
    """Item metrics by attributes of the seller and date dimensions."""
    names = ["seller_id", "order_purchase_timestamp", "is_cancelled", "is_delivered", "is_late",
             "item_value", "freight_value", "price", "review_score"]
    fact = _item(raw, *names).withColumn("date", F.to_date("order_purchase_timestamp"))
    calendar = date_dimension(raw.orders, "order_purchase_timestamp").select("date", "year", "quarter")
    sellers = raw.sellers.select("seller_id", "seller_state")
    joined = with_dims(
        fact,
        {"date": calendar, "seller_id": sellers},
        {"seller_id": raw.hot("order_items", "seller_id")},
    )
    measured = metrics.evaluate(joined, metrics.ITEM_METRICS, ["year", "quarter", "seller_state"])
    return metrics.at_edge(measured)


@query
def revenue_mom(raw):
    fact = _order(raw, "order_month", "is_cancelled", "order_value", "customer_unique_id")
    return pages.revenue_by_month_with_mom(fact)


@query
def revenue_ytd(raw):
    fact = _order(raw, "order_month", "is_cancelled", "order_value")
    return metrics.at_edge(metrics.revenue_by_month(fact))


@query
def revenue_mom_by_state(raw):
    fact = _order(raw, "order_month", "is_cancelled", "order_value", "customer_state", "delivery_bucket")
    return metrics.at_edge(metrics.revenue_by_month(fact, ["customer_state", "delivery_bucket"]))


@query
def months_filled(raw):
    """Monthly revenue per state and bucket with the missing calendar months added."""
    fact = _order(raw, "order_month", "is_cancelled", "order_value", "customer_state", "delivery_bucket")
    dims = ["customer_state", "delivery_bucket"]
    monthly = metrics.evaluate(sales_rows(fact), ["total_revenue"], [*dims, "order_month"])
    return fill_months(monthly, "order_month", dims)


@query
def grain_check(raw):
    return metrics.grain_check(_order(raw, "order_id"))


@query
def tie_out(raw):
    order = _order(raw, "order_value", "is_cancelled")
    return metrics.tie_out(order, _item(raw, "item_value", "is_cancelled"))


# report pages


@query
def kpi_cards(raw):
    return pages.kpi_cards(_order(raw))


@query
def revenue_by_state(raw):
    return pages.revenue_by_state(_order(raw, "is_cancelled", "order_value", "customer_state"))


@query
def aov_trend(raw):
    return pages.aov_trend(_order(raw, *ORDER_ONLY))


@query
def order_value_hist(raw):
    return pages.order_value_distribution(_order(raw, "is_cancelled", "order_value"), 5000)


@query
def items_per_order_dist(raw):
    return pages.items_per_order_distribution(_order(raw, "is_cancelled", "item_count"))


@query
def payment_mix(raw):
    return pages.payment_mix(_order(raw, *ORDER_ONLY))


@query
def monthly_trend(raw):
    fact = _order(raw, "order_month", "is_cancelled", "order_value", "customer_unique_id")
    return pages.monthly_trend(fact)


@query
def dropped_months(raw):
    """The other side of the trend's volume filter, with a bound that drops some months."""
    return pages.dropped_months(_order(raw, "order_month", "is_cancelled", "order_value", "customer_unique_id"), 125)


@query
def peak_month(raw):
    return pages.peak_month(_order(raw, "order_month", "is_cancelled", "order_value", "customer_unique_id"))


@query
def growth_inputs(raw):
    return pages.growth_inputs(_order(raw))


@query
def repeat_rate(raw):
    return pages.repeat_rate(_order(raw, "is_cancelled", "customer_unique_id"))


@query
def late_trend(raw):
    return pages.late_trend(_order(raw, "order_month", *LATENESS))


@query
def delivery_hist(raw):
    return pages.delivery_distribution(_order(raw, *DURATIONS), 30)


@query
def median_delivery(raw):
    return pages.median_delivery(_order(raw, *DURATIONS))


@query
def median_delivery_by_state(raw):
    return pages.median_delivery(_order(raw, "customer_state", *DURATIONS), ["customer_state"])


@query
def bucket_step(raw):
    return pages.bucket_steps(_order(raw, *ORDER_ONLY))


@query
def state_table(raw):
    return pages.state_table(_order(raw), benchmark=3.0)


@query
def state_contrast(raw):
    return pages.state_contrast(_order(raw, "customer_state", *DURATIONS, "is_late", "review_score"), STATES)


@query
def state_drivers(raw):
    return pages.state_drivers(_order(raw))


@query
def late_one_star_share(raw):
    return pages.late_one_star_share(_order(raw, *LATENESS))


@query
def counterfactual_gap(raw):
    return pages.counterfactual_gap(_order(raw, *LATENESS))


@query
def top_categories(raw):
    return pages.top_categories(_item(raw), benchmark=3.0)


@query
def category_table(raw):
    return pages.category_table(_item(raw))


@query
def share_of_total(raw):
    return pages.category_treemap(_item(raw))


@query
def cumulative_share(raw):
    return pages.category_concentration(_item(raw))


@query
def price_vs_review(raw):
    return pages.price_vs_review(_item(raw))


@query
def category_drivers(raw):
    return pages.category_drivers(_item(raw))


@query
def category_lateness_split(raw):
    return pages.category_lateness_split(_item(raw))


# reconciliation and audits


@query
def reconciliation(raw):
    order = _order(raw, "order_id", "product_revenue", "order_value", "payment_value")
    items = _item(raw, "order_id", "item_value", "order_status")
    return recon.reconcile(raw, order, items, payment_gap=0.05, unpaid_share=0.03).drop("note")


@query
def check_order(raw):
    """The check table with the place of each row in its written order."""
    order = _order(raw, "order_id", "product_revenue", "order_value", "payment_value")
    items = _item(raw, "order_id", "item_value", "order_status")
    found = recon.reconcile(raw, order, items, payment_gap=0.05, unpaid_share=0.03)
    return shares.with_place(found, F.asc("ord")).select("place", "check", "status")


@query
def report_order(raw):
    """The place of every row of the five reports as they are written out."""
    tables = reports.report_tables(_order(raw), _item(raw))
    return reports.places(tables)


@query
def compare_headline(raw):
    return recon.compare_headline(raw, _order(raw, *LATENESS))


@query
def compare_monthly(raw):
    fact = _order(raw, "order_month", "is_cancelled", "order_value", "customer_unique_id")
    return recon.compare_report(raw, "monthly_sales", reports.monthly_sales(fact))


@query
def compare_category(raw):
    return recon.compare_report(raw, "category_performance", reports.category_performance(_item(raw)))


@query
def compare_state(raw):
    return recon.compare_report(raw, "state_performance", reports.state_performance(_order(raw)))


@query
def compare_delivery(raw):
    report = reports.delivery_vs_review(_order(raw, *ORDER_ONLY))
    return recon.compare_report(raw, "delivery_vs_review", report)


@query
def reconciliation_grown_gap(raw):
    """The checks with bounds that the payments of lines exceed."""
    order = _order(raw, "order_id", "product_revenue", "order_value", "payment_value")
    items = _item(raw, "order_id", "item_value", "order_status")
    return recon.reconcile(raw, order, items, payment_gap=0.02, unpaid_orders=1).drop("note")


@query
def additivity(raw):
    order = _order(raw, "order_value", "is_cancelled")
    return recon.additivity(order, _item(raw, "item_value", "product_category", "is_cancelled"))


@query
def fanout_orders(raw):
    """Orders with items and payments, joined as they should not be."""
    return recon.order_fanout(raw)


@table_query
def fanout_report(t):
    """Customers with orders and events: the wider fan-out."""
    return fanout.fanout_report(
        t["customer"],
        "c_custkey",
        {
            "orders": fanout.Child(t["orders"], "o_custkey", F.col("o_totalprice").cast("decimal(12,2)")),
            "events": fanout.Child(t["events"], "user_id", F.col("value").cast("decimal(12,2)")),
        },
    )


@query
def review_coverage(raw):
    found = recon.orders_without_review(raw)
    return found.withColumn("coverage", rounded(F.col("coverage"), 6))


@table_query
def constraint_report(t):
    return constraints.constraint_report(t, STAR_RULES)


@table_query
def duplicate_reviews(t):
    return grain.duplicate_profile(t["events"], "user_id")


@table_query
def raw_row_counts(t):
    return totals.row_counts(t)


@table_query
def load_audit(t):
    """Row counts beside the two that are known whatever the scale."""
    return totals.load_audit(t, {"region": 5, "nation": 25})


@query
def delivered_from_raw(raw):
    """The delivered population picked straight from raw columns."""
    kept = raw.orders.where(~F.col("order_status").isin(*raw.cancelled_statuses))
    arrived = marts.delivered_by_order(raw).withColumnRenamed(marts.DELIVERED_AT, "delivered_at")
    return kept.join(arrived, "order_id").select("order_id", "customer_id", "order_status", "delivered_at")


BASE_COLUMNS = ("order_id", "is_cancelled", "is_delivered", "order_value", "review_score")


@query
def sales_base(raw):
    return sales_rows(_order(raw, *BASE_COLUMNS))


@query
def delivered_base(raw):
    return delivered_rows(_order(raw, *BASE_COLUMNS))


@query
def reviewed_base(raw):
    return reviewed_rows(_order(raw, *BASE_COLUMNS))


@query
def population_sizes(raw):
    fact = _order(raw, "is_cancelled", "is_delivered", "review_score")
    return fact.agg(
        F.count("*").alias("all_orders"),
        F.count_if(sales()).alias("sales_orders"),
        F.count_if(delivered()).alias("delivered_orders"),
        F.count_if(reviewed()).alias("reviewed_orders"),
    )
