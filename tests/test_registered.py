"""Every registered query against its SQL, and the plans they run as."""

from __future__ import annotations

import os

import oracle
import pytest
from pyspark.sql import functions as F

import registered_oracles
import registered_queries
from __spark_entry__ import entry
from grainwise.operators import grain

SF_DIR = os.environ.get("GRAINWISE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = registered_queries.queries()
SQL = registered_oracles.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def duck():
    con = oracle.connect(SF_DIR)
    yield con
    con.close()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_entry(spark):
    assert entry(spark).columns == ["customer_state", "orders", "revenue", "avg_delivery_days", "late_rate", "avg_review"]


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no table is small enough to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_and_no_python_in_any_plan(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad


def test_scans_read_only_what_a_report_needs(spark, no_broadcast):
    plan = plan_of(QUERIES["delivery_vs_review"](spark, SF_DIR))
    assert "customer.parquet" not in plan and "events.parquet" not in plan
    line_scan = next(x for x in plan.split("\n") if "l_orderkey" in x and "FileScan" in x)
    assert "l_suppkey" not in line_scan and "l_quantity" not in line_scan


def test_filters_reach_the_scan(spark, no_broadcast):
    plan = plan_of(QUERIES["slice_metrics"](spark, SF_DIR))
    assert "GreaterThanOrEqual(o_orderdate,1996-07-01" in plan


def test_orders_are_shuffled_once_by_order(spark, no_broadcast):
    """Orders, collapsed items and reviews share one partitioning by order."""
    plan = plan_of(QUERIES["review_by_lateness"](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning(order_id") == 3
    assert plan.count("Exchange") <= 5


def test_distinct_sellers_combine_on_the_map_side(spark, no_broadcast):
    """By order and seller, then by order: one scan, and only partial sums are shuffled."""
    for name in ("items_by_order", "fct_order"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        assert sum("FileScan" in x and "l_suppkey" in x for x in plan.split("\n")) == 1
        assert "Exchange hashpartitioning(order_id#" in plan and "seller_id" in "".join(x for x in plan.split("\n") if "Exchange" in x)
        assert "REPARTITION" not in plan


def test_hot_keys_add_no_scan(spark, no_broadcast):
    """Customer, order, product and seller keys spread: as many scans as without."""
    from grainwise.operators.joins import join_many_to_one
    from grainwise.plans.marts import build_fct_order, build_fct_order_item
    from grainwise.sources.star import load_star

    plain, hot = load_star(spark, SF_DIR), load_star(spark, SF_DIR)
    hot.hot_rows = 1
    for key in (("orders", "customer_id"), ("order_items", "order_id"), ("order_items", "product_id"), ("order_items", "seller_id")):
        hot.known_hot[key] = [1, 2]

    def scans(raw):
        lines = build_fct_order_item(raw)
        sellers = raw.sellers.select("seller_id", "seller_state")
        with_seller = join_many_to_one(lines, sellers, "seller_id", "left", raw.hot("order_items", "seller_id"))
        return [plan_of(df).count("FileScan") for df in (build_fct_order(raw), with_seller)]

    assert scans(hot) == scans(plain)


def test_no_payment_work_unless_asked_for(spark, no_broadcast):
    """Lines play items, payments and reviews; each role is a scan only where it is used."""
    state, whole = (plan_of(QUERIES[name](spark, SF_DIR)) for name in ("state_performance", "fct_order"))
    assert "payment_value" not in state and scans_in(state, "lineitem") == 2
    assert "payment_value" in whole and scans_in(whole, "lineitem") == 3


def test_undelivered_lines_are_filtered_before_the_shuffle(spark, no_broadcast):
    for name in ("review_by_lateness", "category_performance", "headline_from_raw"):
        lines = plan_of(QUERIES[name](spark, SF_DIR)).split("\n")
        kept = [i for i, x in enumerate(lines) if "Filter" in x and "l_linestatus" in x and "FileScan" not in x]
        assert len(kept) == 1, name
        above = "\n".join(lines[: kept[0]])
        assert "partial_max(line_delivered_at" in above and "Exchange hashpartitioning(order_id" in above


def scans_in(plan: str, table: str) -> int:
    return plan.count(f"{table}.parquet")


def test_one_pass_of_the_fact_for_all_levels(spark, no_broadcast):
    """Plain and distinct measures of every level come from one collapse: each role of a table is read once."""
    for name in ("metrics_cube", "metrics_rollup", "metrics_total", "metrics_by_state", "metrics_by_month", "monthly_sales"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        scans = [x for x in plan.split("\n") if "FileScan" in x]
        items = [x for x in scans if "l_tax" in x and "l_quantity" not in x]
        payments = [x for x in scans if "l_tax" in x and "l_quantity" in x]
        reviews = [x for x in scans if "l_returnflag" in x and "l_tax" not in x]
        orders = [x for x in scans if "o_orderdate" in x]
        whole = name in ("metrics_total", "metrics_by_state", "metrics_by_month")
        assert (len(items), len(orders), len(payments)) == (1, 1, int(whole)), name
        assert len(reviews) == (name != "monthly_sales"), name


def test_reviews_tell_right_from_wrong(spark):
    """Orders with several reviews, unanswered ones and none: each rule changes the result."""
    from grainwise.plans.marts import reviews_by_order
    from grainwise.sources.star import load_star

    raw = load_star(spark, SF_DIR)
    per_order = raw.order_reviews.groupBy("order_id").agg(
        F.count("*").alias("n"), F.count("review_answer_timestamp").alias("answered"), F.count("review_score").alias("scored")
    )
    shape = per_order.agg(*(F.count_if(F.expr(c)) for c in ("n > 1", "answered between 1 and n - 1", "answered = 0", "scored < n"))).first()
    assert min(shape) > 100
    kept = reviews_by_order(raw.order_reviews, ["review_score"])
    # Without the order of answers, or without the dedupe, the fact differs.
    newest = grain.keep_latest(raw.order_reviews, "order_id", ["review_creation_date", "review_id"], ["review_score"])
    assert kept.exceptAll(newest).count() > 100
    assert raw.order_reviews.count() > kept.count()
    reviewed, sold = (QUERIES[name](spark, SF_DIR).count() for name in ("reviewed_base", "sales_base"))
    assert 0 < reviewed < sold
    assert 0 < QUERIES["review_coverage"](spark, SF_DIR).first()["coverage"] < 1
    statuses = {r["check"]: r["status"] for r in QUERIES["reconciliation"](spark, SF_DIR).collect()}
    assert statuses["payments equal order value"] == statuses["every order has a payment row"] == "KNOWN GAP"


def test_constraints_scan_a_table_once_and_once_for_each_reference_outside_its_key(spark, no_broadcast):
    plan = plan_of(QUERIES["constraint_report"](spark, SF_DIR))
    assert scans_in(plan, "lineitem") == 3
    # orders: its own rules, its customers, and its keys for the lines.
    assert scans_in(plan, "orders") == 3
    assert scans_in(plan, "events") == 2


def test_a_median_shuffles_no_exchange_as_wide_as_its_values(spark, no_broadcast):
    """Two passes: sketches, then counts whose rows outside the bracket fall together before the shuffle."""
    plan = plan_of(QUERIES["median_delivery_by_state"](spark, SF_DIR))
    assert "percentile_approx" in plan and plan.count("_zone") > 0
    assert not any("Exchange" in x and "_bin" in x for x in plan.split("\n"))
