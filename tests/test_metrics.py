"""Metrics, reports and pages on the fixture and on small made cases."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from fixture_tables import ORDERS, item, order, raw_tables, review

from grainwise.functions import BUCKET_LABELS
from grainwise.operators.populations import sales
from grainwise.plans import metrics, pages, reports
from grainwise.plans.marts import build_fct_order, build_fct_order_item
from grainwise.plans.metrics import ITEM_METRICS, METRICS, ORDER_METRICS, evaluate
from grainwise.plans.reconciliation import additivity, compare_headline, orders_without_review, reconcile


@pytest.fixture(scope="module")
def fact(raw):
    return build_fct_order(raw)


@pytest.fixture(scope="module")
def item_fact(raw):
    return build_fct_order_item(raw)


def test_order_metrics_of_the_fixture(fact):
    got = evaluate(fact, ORDER_METRICS).first()
    assert got["total_revenue"] == 752
    assert got["product_revenue"] == 675
    assert got["freight_revenue"] == 77
    assert (got["total_orders"], got["total_customers"]) == (5, 3)
    assert got["aov"] == pytest.approx(752 / 5)
    assert got["items_per_order"] == pytest.approx(9 / 5)
    assert (got["delivered_orders"], got["late_orders"]) == (4, 2)
    assert got["late_delivery_rate"] == pytest.approx(2 / 4)
    assert got["on_time_delivery_rate"] == pytest.approx(2 / 4)
    assert got["avg_delivery_vs_promise"] == pytest.approx((-12 + 0 + 1 + 6) / 4)
    assert got["avg_promised_days"] == pytest.approx((17 + 16 / 24 + 8 + 8 + 8) / 4)
    assert got["avg_review_score"] == pytest.approx((4 + 3 + 1 + 2) / 4)
    assert (got["reviewed_orders"], got["review_coverage"]) == (4, pytest.approx(4 / 5))
    assert got["one_star_rate"] == pytest.approx(1 / 4)
    assert got["review_gap_late_vs_on_time"] == pytest.approx((1 + 2) / 2 - (4 + 3) / 2)
    assert got["revenue_at_risk"] == 115 + 272
    assert got["late_revenue_share"] == pytest.approx(387 / 752)
    assert got["payments_over_item_value"] == pytest.approx(595 / 862 - 1)


def test_item_metrics_of_the_fixture(item_fact):
    got = {r["product_category"]: r for r in evaluate(item_fact, ITEM_METRICS, ["product_category"]).collect()}
    assert set(got) == {"Office Furniture", "Technical Books", "Unknown"}
    office = got["Office Furniture"]
    assert (office["category_revenue"], office["items_sold"]) == (Decimal("449.50"), 4)
    assert office["category_late_rate"] == pytest.approx(2 / 3)
    assert office["freight_share"] == pytest.approx(35.5 / 449.5)
    assert sum(r["category_revenue"] for r in got.values()) == 752


def test_every_metric_is_resolvable_alone(fact, item_fact):
    for name, metric in METRICS.items():
        df = evaluate(fact if metric.fact == "order" else item_fact, [name])
        assert df.columns == [name]


def test_group_without_deliveries_has_null_rates(spark):
    raw = raw_tables(spark, orders=[order("o9", "c1", "shipped", "2017-01-01", None, "2017-01-10")])
    got = evaluate(build_fct_order(raw), ORDER_METRICS, ["customer_state"]).first()
    assert got["delivered_orders"] == 0
    for name in ("late_delivery_rate", "on_time_delivery_rate", "avg_delivery_days", "review_gap_late_vs_on_time"):
        assert got[name] is None, name


def test_slicer_intersects_the_population(fact):
    assert evaluate(fact.where("order_status = 'canceled'"), ["total_orders", "total_revenue"]).first()[0] == 0


def test_aov_and_mean_of_valued_orders_differ_when_an_order_has_no_items(spark):
    raw = raw_tables(spark, orders=[*ORDERS, order("o5", "c1", "shipped", "2017-05-01", None, "2017-05-09")])
    got = evaluate(build_fct_order(raw), ["aov", "avg_valued_order"]).first()
    assert (got["aov"], got["avg_valued_order"]) == (pytest.approx(752 / 6), pytest.approx(752 / 5))


def test_rollup_recomputes_distinct_counts(fact):
    rows = evaluate(fact, ["total_customers", "total_orders"], ["customer_state"], "rollup").collect()
    total = [r for r in rows if r["grouping_id"] == 1]
    assert [(r["total_customers"], r["total_orders"]) for r in total] == [(3, 5)]
    assert sum(r["total_customers"] for r in rows if r["grouping_id"] == 0) == 4


def test_sketched_customers_are_close(fact):
    assert evaluate(fact, ["total_customers", "total_orders"], approximate=True).first()[0] == 3


def test_evaluate_rejects_mixed_facts_and_unknown_groupings(fact):
    with pytest.raises(ValueError):
        evaluate(fact, ["total_revenue", "items_sold"])
    with pytest.raises(ValueError):
        evaluate(fact, ["total_revenue"], ["customer_state"], "pivot")


def test_diagnostics(fact, item_fact):
    assert metrics.grain_check(fact).first()["grain_check"] == "OK - 6 orders"
    assert metrics.grain_check(fact.unionByName(fact)).first()["grain_check"] == "BROKEN - 12 rows for 6 orders"
    assert metrics.tie_out(fact, item_fact).first()["tie_out"] == "OK"
    off = metrics.tie_out(fact, item_fact.where("order_id <> 'k10'")).first()["tie_out"]
    assert off == "MISMATCH 140.00"


def test_revenue_by_month(fact):
    rows = metrics.revenue_by_month(fact).orderBy("order_month").collect()
    assert [r["total_revenue"] for r in rows] == [275, 115, 362]
    assert [r["total_revenue_ytd"] for r in rows] == [275, 390, 752]
    assert rows[0]["total_revenue_mom"] is None
    assert rows[1]["total_revenue_mom"] == pytest.approx(115 / 275 - 1)


# reports


def test_monthly_sales(fact):
    rows = [tuple(r) for r in reports.monthly_sales(fact).orderBy("order_month").collect()]
    assert rows[0] == (date(2018, 5, 1), 2, Decimal("275.00"), 137.5, 2)
    assert len(rows) == 3


def test_category_late_rate_skips_undelivered_lines(spark):
    """One late and one undelivered line of a category: 1.0, not 0.5."""
    orders = [
        order("a", "c1", "delivered", "2017-01-01", "2017-01-20", "2017-01-10"),
        order("b", "c1", "shipped", "2017-01-01", None, "2017-01-10"),
    ]
    raw = raw_tables(spark, orders=orders, items=[item("a", 1, "w1", "v1", 1, 0), item("b", 1, "w1", "v1", 1, 0)])
    fact = build_fct_order_item(raw)
    assert reports.category_performance(fact).first()["late_rate"] == 1.0
    assert evaluate(fact, ["category_late_rate"]).first()[0] == 1.0


def test_delivery_buckets_keep_empty_ones(fact):
    rows = reports.delivery_vs_review(fact).orderBy("bucket_ord").collect()
    assert [r["delivery_bucket"] for r in rows] == list(BUCKET_LABELS)
    assert [r["orders"] for r in rows] == [1, 0, 1, 1, 1, 0]
    assert rows[1]["avg_review"] is None
    bare = reports.delivery_vs_review(fact, keep_empty=False).orderBy("bucket_ord").collect()
    assert [(r["bucket_ord"], r["orders"]) for r in bare] == [(1, 1), (3, 1), (4, 1), (5, 1)]


def test_lateness_report_and_headline_agree(raw, fact):
    rows = {r["is_late"]: tuple(r)[1:] for r in reports.review_by_lateness(fact).collect()}
    assert rows == {False: (2, 3.5, 0.0, 0.0), True: (2, 1.5, 0.5, 0.0)}
    assert all(r["ok"] for r in compare_headline(raw, fact).collect())


def test_star_share_counts_unreviewed_orders(spark):
    raw = raw_tables(spark, reviews=[review("r1", "k10", 1, "2018-05-22", "2018-05-23")])
    rows = {r["is_late"]: r["pct_1_star"] for r in reports.review_by_lateness(build_fct_order(raw)).collect()}
    assert rows == {False: 0.5, True: 0.0}


def test_report_order(fact, item_fact):
    tables = reports.report_tables(fact, item_fact)
    revenue = [r["revenue"] for r in tables["category_performance"].collect()]
    assert revenue == sorted(revenue, reverse=True)
    assert [r["bucket_ord"] for r in tables["delivery_vs_review"].collect()] == [1, 2, 3, 4, 5, 6]


# pages


def test_pages_on_the_fixture(fact, item_fact):
    assert pages.kpi_cards(fact).first()["aov"] == 150.4
    assert pages.repeat_rate(fact).first()["repeat_rate"] == pytest.approx(2 / 3, abs=1e-6)
    middle = (8 + 22.5 / 24 + 9 + 0.5 / 24) / 2
    assert pages.median_delivery(fact).first()["median_delivery_days"] == pytest.approx(middle, abs=1e-6)
    assert pages.approx_median_delivery(fact).first()["median_delivery_days"] == pytest.approx(middle, abs=0.05)
    risk = pages.late_one_star_share(fact).first()
    assert (risk["one_star"], risk["late_share_of_one_star"], risk["one_star_risk_ratio"]) == (1, 1.0, None)
    bound = pages.counterfactual_gap(fact).first()
    assert bound["bound"] == pytest.approx(3.5 - 2.5, abs=1e-6)
    assert [r["orders"] for r in pages.dropped_months(fact).collect()] == [2, 1, 2]
    peak = pages.peak_month(fact, minimum=0).first()
    assert (peak["peak_month"], peak["peak_revenue"]) == (date(2018, 7, 1), 362)
    assert (peak["first_month"], peak["last_month"]) == ("May 2018", "Jul 2018")
    trend = pages.monthly_trend(fact, minimum=0).collect()
    assert {r["period_aov"] for r in trend} == {150.4}
    steps = {r["delivery_bucket"]: (r["avg_review_step"], r["early"]) for r in pages.bucket_steps(fact).collect()}
    assert steps["1-3 days late"] == (-2.0, False)
    split = {r["product_category"]: r for r in pages.category_lateness_split(item_fact).where("is_total").collect()}
    assert split[None]["category_late_rate"] == pytest.approx(3 / 6, abs=1e-6)
    mix = {(r["primary_payment_type"], r["max_installments"]): r["orders_share"] for r in pages.payment_mix(fact).collect()}
    assert mix[("credit_card", 4)] == pytest.approx(1 / 5, abs=1e-6)
    assert mix[("boleto", 3)] == pytest.approx(1 / 5, abs=1e-6)
    states = {r["customer_state"]: r for r in pages.state_table(fact).collect()}
    assert states["PR"]["revenue_scaled"] == 1.0 and states["BA"]["below_benchmark"] is True
    # Both states score the same, so nothing goes with the score.
    assert tuple(pages.state_drivers(fact).first()) == (2, None, None)
    assert pages.category_drivers(item_fact, minimum=1).first()["categories"] == 3
    assert {r["customer_state"] for r in pages.state_contrast(fact, ["BA"]).collect()} == {"BA"}


# reconciliation


def test_reconciliation_of_the_fixture(raw, fact, item_fact):
    rows = {r["check"]: (r["status"], r["expected"], r["actual"]) for r in reconcile(raw, fact, item_fact).collect()}
    assert rows["fct_order is one row per order"] == ("PASS", "6", "6")
    assert rows["fct_order_item preserves every item line"] == ("PASS", "10", "10")
    assert rows["product revenue ties to raw item prices"] == ("PASS", "774.00", "774.00")
    assert rows["order value ties to item grain"] == ("PASS", "862.00", "862.00")
    assert rows["payments equal order value"] == ("KNOWN GAP", "862.00", "595.00")
    assert rows["every order has a payment row"] == ("KNOWN GAP", "0", "1")


def test_notes_state_the_gap(raw, fact, item_fact):
    notes = [r["note"] for r in reconcile(raw, fact, item_fact).orderBy("ord").collect()]
    assert all(notes) and "-30.97%" in notes[4]


def test_a_grown_gap_fails(raw, fact, item_fact):
    status = [r["status"] for r in reconcile(raw, fact, item_fact, 0.30, 0).orderBy("ord").collect()]
    assert status == ["PASS"] * 4 + ["FAIL"] * 2
    status = [r["status"] for r in reconcile(raw, fact, item_fact, 0.31, 1).orderBy("ord").collect()]
    assert status == ["PASS"] * 4 + ["KNOWN GAP"] * 2


def test_a_fanned_out_fact_fails(raw, fact, item_fact):
    broken = fact.join(raw.order_payments.select("order_id", "payment_sequential"), "order_id", "left")
    status = [r["status"] for r in reconcile(raw, broken, item_fact).orderBy("ord").collect()]
    assert status[:4] == ["FAIL", "PASS", "FAIL", "FAIL"]


def test_category_revenue_is_additive(fact, item_fact):
    row = additivity(fact, item_fact).first()
    assert (row["sum_of_categories"], row["total_revenue"], row["additive"]) == (752, 752, True)


def test_review_coverage(spark):
    raw = raw_tables(spark, reviews=[review("r1", "k10", 1, "2018-05-22", "2018-05-23")])
    row = orders_without_review(raw).first()
    assert (row["orders"], row["orders_without_review"], row["coverage"]) == (6, 5, pytest.approx(1 / 6))


def test_sales_population_is_never_null(spark):
    fact = build_fct_order(raw_tables(spark, orders=[order("o1", "c1", None, "2017-01-01", None, "2017-01-10")]))
    assert fact.where(sales()).count() == 1
