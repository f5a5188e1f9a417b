"""The fixture: grain, totals, lateness, buckets, reviews, categories, nulls."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from fixture_tables import ITEMS, ORDERS, frame, item, order, payment, product, raw_tables, review

from pyspark.sql import functions as F

from grainwise.functions import ratio
from grainwise.plans import reports
from grainwise.plans.marts import (
    ITEM_COLUMNS,
    ORDER_COLUMNS,
    build_dim_product,
    build_fct_order,
    build_fct_order_item,
    payments_by_order,
    reviews_by_order,
)


def test_grain(orders, lines):
    assert len(orders) == 6
    assert len(lines) == 10


def test_columns(raw):
    assert build_fct_order(raw).columns == list(ORDER_COLUMNS)
    assert build_fct_order_item(raw).columns == list(ITEM_COLUMNS)


def test_nothing_is_counted_twice(orders, lines):
    assert sum(r["order_value"] or 0 for r in orders.values()) == Decimal(862)
    assert sum(r["item_value"] for r in lines) == Decimal(862)
    assert (orders["k14"]["item_count"], orders["k14"]["order_value"], orders["k14"]["seller_count"]) == (3, 90, 3)


def test_payments_are_collapsed(orders):
    split = orders["k11"]
    assert (split["payment_value"], split["payment_splits"], split["max_installments"]) == (140, 3, 4)
    assert split["primary_payment_type"] == "credit_card"
    assert orders["k13"]["payment_value"] is None


def test_lateness_is_in_whole_days_and_three_valued(spark, raw, orders):
    assert [orders[o]["delay_days"] for o in sorted(orders)] == [-12, 0, 1, 6, None, None]
    assert [orders[o]["is_late"] for o in sorted(orders)] == [False, False, True, True, None, None]
    rate = build_fct_order(raw).agg(ratio(F.sum(F.col("is_late").cast("int")), F.count("is_late")).alias("r"))
    assert rate.first()["r"] == pytest.approx(1 / 2)


def test_durations_keep_their_fraction(orders):
    assert orders["k10"]["delivery_days"] == 6.25
    assert orders["k11"]["estimated_days"] == 8.0
    assert orders["k15"]["delivery_days"] is None


def test_buckets(orders):
    labels = [orders[o]["delivery_bucket"] for o in sorted(orders)]
    assert labels == ["10+ days early", "0-3 days early", "1-3 days late", "3-10 days late", None, None]


def test_latest_review_wins(orders):
    assert orders["k11"]["review_score"] == 3


def test_missing_category(lines):
    assert {r["product_category"] for r in lines if r["product_id"] == "w3"} == {"Unknown"}
    assert {r["product_category"] for r in lines if r["product_id"] == "w1"} == {"Office Furniture"}


def test_cancelled_orders_are_flagged_and_kept(orders):
    assert [o for o in sorted(orders) if orders[o]["is_cancelled"]] == ["k15"]


def test_months_and_dates(orders):
    assert orders["k12"]["order_month"] == date(2018, 6, 1)
    assert orders["k13"]["order_date"] == date(2018, 7, 2)


def test_missing_children_stay_null(spark):
    """No items, no payments, no review, an unknown customer: NULL, not zero, and no lost row."""
    extra = order("o5", "nobody", "delivered", "2017-05-01", "2017-05-03", "2017-05-09")
    raw = raw_tables(spark, orders=[*ORDERS, extra])
    rows = {r["order_id"]: r for r in build_fct_order(raw).collect()}
    assert len(rows) == 7
    o5 = rows["o5"]
    for name in ("item_count", "order_value", "payment_value", "payment_splits", "review_score", "customer_state"):
        assert o5[name] is None, name


def test_null_status_is_not_cancelled(spark):
    rows = build_fct_order(raw_tables(spark, orders=[order("o1", "c1", None, "2017-01-01", None, "2017-01-10")]))
    assert rows.first()["is_cancelled"] is False


def test_delivered_without_promise_has_no_outcome(spark):
    raw = raw_tables(spark, orders=[order("o1", "c1", "delivered", "2017-01-01", "2017-01-08", None)])
    row = build_fct_order(raw).first()
    assert row["is_delivered"] is True
    assert (row["delay_days"], row["is_late"], row["delivery_bucket"]) == (None, None, None)
    found = reports.delivery_vs_review(build_fct_order(raw)).collect()
    assert sum(r["orders"] for r in found) == 1
    assert [r["orders"] for r in found if r["delivery_bucket"] is None] == [1]


def test_answered_review_beats_unanswered(spark):
    rows = [
        review("r1", "o1", 1, "2017-01-11", None),
        review("r2", "o1", 5, "2017-01-02", "2017-01-03"),
        review("r3", "o2", 2, "2017-01-11", None),
    ]
    scores = {r["order_id"]: r["review_score"] for r in reviews_by_order(raw_tables(spark, reviews=rows).order_reviews).collect()}
    assert scores == {"o1": 5, "o2": 2}


def test_review_ties_fall_to_creation_then_id(spark):
    rows = [
        review("r1", "o1", 1, "2017-01-11", "2017-01-12"),
        review("r2", "o1", 2, "2017-01-10", "2017-01-12"),
        review("r4", "o2", 4, "2017-01-11", "2017-01-12"),
        review("r3", "o2", 3, "2017-01-11", "2017-01-12"),
    ]
    for ordering in (rows, rows[::-1]):
        raw = raw_tables(spark, reviews=ordering)
        scores = {r["order_id"]: r["review_score"] for r in reviews_by_order(raw.order_reviews).collect()}
        assert scores == {"o1": 1, "o2": 4}


def test_payment_ties_and_null_values(spark):
    rows = [
        payment("o1", 2, "voucher", 1, 50),
        payment("o1", 1, "boleto", 1, 50),
        payment("o2", 1, "voucher", 1, None),
        payment("o2", 2, "boleto", 1, 10),
        payment("o3", 1, "voucher", 1, None),
    ]
    found = {r["order_id"]: r for r in payments_by_order(raw_tables(spark, payments=rows).order_payments).collect()}
    assert found["o1"]["primary_payment_type"] == "boleto"
    assert found["o2"]["primary_payment_type"] == "boleto"
    assert found["o3"]["primary_payment_type"] == "voucher"
    assert found["o3"]["payment_value"] is None
    assert found["o3"]["payment_splits"] == 1


def test_category_labels(spark):
    products = frame(
        spark,
        "products",
        [product("a", "livros_tecnicos", 1.0), product("b", "pc_gamer 2", 1.0), product("c", None, 1.0), product("d", "o'NEIL_fashion-bags", 1.0)],
    )
    labels = {
        r["product_id"]: r["product_category"]
        for r in build_dim_product(products, raw_tables(spark).category_translation).collect()
    }
    assert labels == {"a": "Technical Books", "b": "Pc Gamer 2", "c": "Unknown", "d": "O'neil Fashion-bags"}


def test_item_of_unknown_product_keeps_its_line(spark):
    raw = raw_tables(spark, items=[*ITEMS, item("k12", 3, "ghost", "v1", 5, 1), item("k12", 4, None, "v1", 5, 1)])
    rows = build_fct_order_item(raw).collect()
    assert len(rows) == 12
    assert sum(r["product_category"] == "Unknown" for r in rows) == 4


def test_hot_keys_change_nothing(spark, raw):
    """Every key treated as heavy: both facts stay as they are."""
    plain_orders = sorted(map(repr, build_fct_order(raw).collect()))
    plain_lines = sorted(map(repr, build_fct_order_item(raw).collect()))
    heavy = raw_tables(spark, hot_rows=2)
    assert raw.hot("order_items", "order_id") == []
    assert heavy.hot("order_items", "order_id") and heavy.hot("orders", "customer_id")
    assert sorted(map(repr, build_fct_order(heavy).collect())) == plain_orders
    assert sorted(map(repr, build_fct_order_item(heavy).collect())) == plain_lines


def test_subset_of_columns_equals_the_full_mart(spark, raw, orders):
    rows = build_fct_order(raw, ["order_id", "is_late", "order_value"]).collect()
    assert {r["order_id"]: (r["is_late"], r["order_value"]) for r in rows} == {
        o: (r["is_late"], r["order_value"]) for o, r in orders.items()
    }
