"""Each operator against hand-made input or brute force."""

from __future__ import annotations

import random
import statistics
from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainwise.functions import BUCKET_EDGES, BUCKET_LABELS, bucketize, days_between, rounded
from grainwise.functions.delivery import micros_between
from grainwise.operators.calendar import date_dimension, fill_months, month_over_month, year_to_date
from grainwise.operators.checks import Check, ChecksFailed, compare_tables, require_no_failures, run_checks, with_status
from grainwise.operators.constraints import ForeignKey, TableRules, constraint_report, orphan_keys
from grainwise.operators.fanout import Child, fanout_report
from grainwise.operators.grain import collapse, duplicate_profile, keep_latest, top_by
from grainwise.operators.joins import HOT_LIMIT, hot_keys, join_many_to_one, with_dims
from grainwise.operators.populations import enough_volume, slice_rows, too_little_volume
from grainwise.operators.shares import cumulative_share, scaled_to_max, share_of_total, step_change, top_n
from grainwise.operators.stats import correlation, exact_median, histogram, paired_histogram
from grainwise.operators.totals import load_audit, merge_groups, merge_totals


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# buckets and rounding


def test_bucket_edges_are_right_closed(spark):
    expected = {
        -11: "10+ days early", -10: "10+ days early", -9: "3-10 days early", -4: "3-10 days early",
        -3: "3-10 days early", -2: "0-3 days early", 0: "0-3 days early", 1: "1-3 days late",
        3: "1-3 days late", 4: "3-10 days late", 10: "3-10 days late", 11: "10+ days late", None: None,
    }
    df = spark.createDataFrame([(k,) for k in expected], "d int")
    found = df.select("d", bucketize(F.col("d"), BUCKET_EDGES, BUCKET_LABELS).alias("b")).collect()
    assert {r["d"]: r["b"] for r in found} == expected


def test_bucketize_rejects_bad_bins():
    with pytest.raises(ValueError):
        bucketize(F.lit(1), (0, 1), ("a", "b"))
    with pytest.raises(ValueError):
        bucketize(F.lit(1), (1, 0), ("a", "b", "c"))


def test_ties_round_half_up(spark):
    df = spark.createDataFrame([(23 / 40, 2), (0.0005, 3), (-0.0005, 3), (2.675, 2)], "x double, n int")
    got = [df.where(F.col("x") == x).select(rounded(F.col("x"), n).alias("r")).first()["r"] for x, n in df.collect()]
    assert got == [0.58, 0.001, -0.001, 2.68]


def test_durations_ignore_the_session_time_zone(spark):
    df = spark.createDataFrame(
        [(datetime(2017, 10, 14), datetime(2017, 10, 16, 12, 0, 0, 1)), (datetime(2018, 2, 18), datetime(2018, 2, 17))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [tuple(r) for r in df.select(micros_between(F.col("a"), F.col("b")), days_between(F.col("a"), F.col("b"))).collect()]
            assert got == [(216_000_000_001, 216_000_000_001 / 86_400_000_000), (-86_400_000_000, -1.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# grain


def test_keep_latest_is_independent_of_row_order(spark):
    data = [("a", 1, None, "x"), ("a", 2, 5, "y"), ("a", 3, 5, "z"), ("b", 1, None, "w"), (None, 9, 1, "n")]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "k string, id int, t int, v string")
        assert rows(keep_latest(df, "k", ["t", "id"], ["v"])) == [("a", "z"), ("b", "w"), (None, "n")]


def test_keep_latest_of_rows_with_null_values(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "old")], "k string, t int, v string")
    assert rows(keep_latest(df, "k", ["t"])) == [("a", 2, None)]


def test_top_by_and_collapse(spark):
    df = spark.createDataFrame([("a", "x", 3, 1), ("a", "y", 3, 0), ("a", "z", 1, 2)], "k string, t string, v int, s int")
    out = collapse(df, "k", {"n": F.count("*"), "top": top_by(F.col("t"), F.col("v"), -F.col("s"))})
    assert rows(out) == [("a", 3, "y")]


def test_duplicate_profile(spark):
    df = spark.createDataFrame([("r1",), ("r1",), ("r2",), ("r3",), ("r3",), ("r3",)], "id string")
    assert duplicate_profile(df, "id").first().asDict() == {
        "row_count": 6, "distinct_keys": 3, "repeated_keys": 2, "surplus_rows": 3, "max_per_key": 3,
    }


def test_duplicate_profile_of_nothing(spark):
    empty = duplicate_profile(spark.createDataFrame([], "id string"), "id").first()
    assert (empty["row_count"], empty["surplus_rows"]) == (0, 0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_mart_totals_equal_raw_totals_whatever_the_fanout(spark, data):
    from fixture_tables import item, order, payment, raw_tables, review

    from grainwise.plans.marts import build_fct_order, build_fct_order_item

    n = data.draw(st.integers(1, 5))
    count = st.integers(0, 4)
    cents = st.integers(0, 10_000).map(lambda c: str(Decimal(c) / 100))
    orders = [order(f"o{i}", "c1", "delivered", "2017-01-01", "2017-01-05", "2017-01-04") for i in range(n)]
    items = [item(f"o{i}", k, "p1", "s1", data.draw(cents), data.draw(cents)) for i in range(n) for k in range(data.draw(count))]
    pays = [payment(f"o{i}", k, "x", 1, data.draw(cents)) for i in range(n) for k in range(data.draw(count))]
    revs = [review(f"r{i}{k}", f"o{i}", 3, "2017-01-01", "2017-01-02") for i in range(n) for k in range(data.draw(count))]
    raw = raw_tables(spark, orders=orders, items=items, payments=pays, reviews=revs)
    fact = build_fct_order(raw, ["order_id", "order_value", "payment_value", "review_score"]).collect()
    assert len(fact) == n
    assert sum(r["order_value"] or 0 for r in fact) == sum(i["price"] + i["freight_value"] for i in items)
    assert sum(r["payment_value"] or 0 for r in fact) == sum(p["payment_value"] for p in pays)
    assert build_fct_order_item(raw, ["order_id", "item_value", "is_late"]).count() == len(items)


# joins


def skewed(spark, n=3000):
    """A third of the rows on one key, some on NULL, one key without a parent."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40)
    return spark.range(n).select(F.col("id").alias("line"), key.cast("int").alias("k"))


def test_hot_keys_finds_the_heavy_one(spark):
    assert hot_keys(skewed(spark), "k", min_rows=250) == [7]
    assert hot_keys(skewed(spark), "k", min_rows=1_000_000) == []
    assert hot_keys(skewed(spark), "k", min_rows=1)[-1] is None


def test_hot_keys_of_nothing(spark):
    assert hot_keys(skewed(spark).limit(0), "k", min_rows=0) == []


def test_missing_keys_are_held_back_too(spark):
    many = skewed(spark).withColumn("k", F.when(F.col("line") % 2 == 0, F.col("k")))
    one = spark.createDataFrame([(k, f"name{k}") for k in range(35)], "k int, name string")
    plain = rows(many.join(one, "k", "left").select("line", "name"))
    assert rows(join_many_to_one(many, one, "k", "left", hot=[None]).select("line", "name")) == plain


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_join_equals_plain_join(spark, how):
    many = skewed(spark)
    one = spark.createDataFrame([(k, f"name{k}") for k in range(35)], "k int, name string")
    plain = rows(many.join(one, "k", how).select("line", "k", "name"))
    split = rows(join_many_to_one(many, one, "k", how, hot=[7, 39]).select("line", "k", "name"))
    assert split == plain
    assert len(split) == (3000 if how == "left" else many.where("k < 35").count())


def test_hot_join_bounds_its_broadcast(spark):
    with pytest.raises(ValueError):
        join_many_to_one(skewed(spark), skewed(spark), "k", hot=range(HOT_LIMIT + 2))
    with pytest.raises(ValueError):
        join_many_to_one(skewed(spark), skewed(spark), "k", "full")


def test_with_dims_keeps_fact_rows_and_columns(spark):
    fact = spark.createDataFrame([(1, 1, "f"), (2, 9, "g"), (3, None, "h")], "id int, k int, city string")
    dim = spark.createDataFrame([(1, "SP", "dim city")], "k int, state string, city string")
    assert rows(with_dims(fact, {"k": dim}).select("id", "state", "city")) == [
        (1, "SP", "f"), (2, None, "g"), (3, None, "h"),
    ]


# fan-out


def test_fanout_of_the_fixture(spark, raw):
    from grainwise.plans.reconciliation import order_fanout

    got = order_fanout(raw).first()
    assert (got["parent_rows"], got["naive_rows"]) == (6, 13)
    assert (got["true_revenue"], got["naive_revenue"]) == (862, 975)
    assert (got["true_payments"], got["naive_payments"]) == (595, 1030)
    assert (got["pct_revenue_overstated"], got["pct_payments_overstated"]) == (13.1, 73.1)


def test_fanout_equals_the_literal_join(spark):
    rng = random.Random(5)
    parent = spark.createDataFrame([(i,) for i in range(20)] + [(3,)], "p int")
    a = spark.createDataFrame([(rng.randrange(25), Decimal(rng.randrange(1000)) / 100) for _ in range(90)], "k int, v decimal(12,2)")
    b = spark.createDataFrame([(rng.randrange(25), Decimal(rng.randrange(1000)) / 100) for _ in range(70)], "k int, w decimal(12,2)")
    c = spark.createDataFrame([(rng.randrange(25), rng.randrange(9)) for _ in range(40)], "k int, x int")
    got = fanout_report(
        parent, "p", {"a": Child(a, "k", F.col("v")), "b": Child(b, "k", F.col("w")), "c": Child(c, "k", F.col("x"))}
    ).first()
    naive = (
        parent.join(a, parent["p"] == a["k"]).join(b, parent["p"] == b["k"]).join(c, parent["p"] == c["k"])
        .agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"), F.sum("x").alias("x")).first()
    )
    assert (got["naive_rows"], got["naive_a"], got["naive_b"], got["naive_c"]) == tuple(naive)


def test_fanout_without_matches(spark):
    parent = spark.createDataFrame([(1,)], "p int")
    child = spark.createDataFrame([(2, 5)], "k int, v int")
    got = fanout_report(parent, "p", {"a": Child(child, "k", F.col("v"))}).first()
    assert (got["naive_rows"], got["naive_a"], got["true_a"], got["pct_a_overstated"]) == (0, None, 5, None)


# constraints


def test_a_repeated_dimension_key_fails_the_query(spark):
    fact = spark.createDataFrame([(1, 10.0), (2, 20.0), (None, 5.0)], "seller_id int, price double")
    sellers = spark.createDataFrame([(1, "A"), (2, "B"), (None, "C"), (None, "D")], "seller_id int, state string")
    kept = with_dims(fact, {"seller_id": sellers})
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, 10.0, "A"), (2, 20.0, "B"), (None, 5.0, None)]))
    doubled = with_dims(fact, {"seller_id": sellers.unionByName(spark.createDataFrame([(2, "E")], sellers.schema))})
    for result in (doubled, doubled.groupBy("state").agg(F.sum("price"))):
        with pytest.raises(Exception, match="seller_id is not unique: 2"):
            result.collect()


def test_constraints_of_composite_keys_with_references(spark):
    """Key, references inside and outside the key, nulls and domains of one table, each against a plain count."""
    a = spark.createDataFrame([(1,), (2,), (2,)], "a_id int")
    b = spark.createDataFrame([(7,), (8,)], "b_id int")
    lines = [(1, 7, 5), (1, 7, 5), (2, 9, None), (3, 8, 50), (None, 8, 1), (3, 9, 2), (4, None, 1), (4, None, -1)]
    tables = {"a": a, "b": b, "lines": spark.createDataFrame(lines, "a_id int, b_id int, v int")}
    rules = {
        "a": TableRules(key=("a_id",)),
        "b": TableRules(key=("b_id",), not_null=("b_id",)),
        "lines": TableRules(
            key=("a_id", "b_id"), foreign_keys=(ForeignKey("a_id", "a", "a_id"), ForeignKey("b_id", "b", "b_id")),
            not_null=("a_id", "v"), between={"v": (0, 10)},
        ),
        # The same rows without a key: references have scans of their own.
        "free": TableRules(foreign_keys=(ForeignKey("b_id", "b", "b_id"),), between={"v": (0, 10)}),
    }
    tables["free"] = tables["lines"]
    found = {(r["table_name"], r["rule"], r["columns"]): r["violations"] for r in constraint_report(tables, rules).collect()}
    assert found == {
        ("a", "primary_key", "a_id"): 1, ("b", "primary_key", "b_id"): 0, ("b", "not_null", "b_id"): 0,
        ("lines", "primary_key", "a_id,b_id"): 1 + 1 + 2, ("lines", "not_null", "a_id"): 1, ("lines", "not_null", "v"): 1,
        ("lines", "between", "v"): 2, ("lines", "foreign_key", "a_id"): 4, ("lines", "foreign_key", "b_id"): 2,
        ("free", "foreign_key", "b_id"): 2, ("free", "between", "v"): 2,
    }
    empty = {name: df.limit(0) for name, df in tables.items()}
    assert {r["violations"] for r in constraint_report(empty, rules).collect()} == {0}


def test_constraint_report(spark):
    parent = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "id int, name string")
    child = spark.createDataFrame([(1, 1, 1), (1, 2, 6), (9, 1, None), (9, 1, 5), (None, 1, 0)], "pid int, n int, score int")
    report = constraint_report(
        {"parent": parent, "child": child},
        {
            "parent": TableRules(key=("id",), not_null=("name",)),
            "child": TableRules(key=("pid", "n"), foreign_keys=(ForeignKey("pid", "parent", "id"),), between={"score": (1, 5)}),
        },
    )
    found = {(r["table_name"], r["rule"], r["columns"]): (r["violations"], r["status"]) for r in report.collect()}
    assert found == {
        ("parent", "primary_key", "id"): (1, "FAIL"),
        ("parent", "not_null", "name"): (1, "FAIL"),
        # one repeated pair and one row with a NULL in its key
        ("child", "primary_key", "pid,n"): (2, "FAIL"),
        ("child", "foreign_key", "pid"): (2, "FAIL"),
        ("child", "between", "score"): (2, "FAIL"),
    }
    assert rows(orphan_keys(child, "pid", parent, "id")) == [(9, 2)]


def test_fixture_keeps_its_promises(raw):
    from grainwise.plans.reconciliation import raw_constraints

    report = raw_constraints(raw).collect()
    assert {r["status"] for r in report} == {"PASS"}
    # 7 keys, 5 references, 14 columns that must be filled, 1 domain
    assert len(report) == 27


# checks


def test_check_states_and_gate(spark):
    totals = spark.createDataFrame([(10, 10, 13)], "a int, b int, c int")

    def check(name, actual, **kw):
        return Check(name, F.col("a"), F.col(actual), F.col("a") == F.col(actual), "note", **kw)

    checks = [
        check("same", "b"),
        check("gap", "c", known_gap=True),
        check("bounded", "c", known_gap=True, gap_bound=F.col("c") <= 13),
        check("grown", "c", known_gap=True, gap_bound=F.col("c") <= 12),
        check("broken", "c"),
    ]
    table = run_checks(totals, checks)
    assert [r["status"] for r in table.orderBy("ord").collect()] == ["PASS", "KNOWN GAP", "KNOWN GAP", "FAIL", "FAIL"]
    assert {r["check"] for r in with_status(table, "KNOWN GAP").collect()} == {"gap", "bounded"}
    with pytest.raises(ChecksFailed, match="broken: expected 10, got 13"):
        require_no_failures(table)
    require_no_failures(run_checks(totals, checks[:3]))


def test_check_on_missing_totals_fails(spark):
    totals = spark.createDataFrame([(None, 1)], "a int, b int")
    table = run_checks(totals, [Check("x", F.col("a"), F.col("b"), F.col("a") == F.col("b"), "")])
    assert table.first()["status"] == "FAIL"


def test_compare_tables(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, None), (None, 3.0, 3)], "k string, v double, n int")
    same = compare_tables(left, left, "k", ["v", "n"]).collect()
    assert all(r["ok"] for r in same) and same[0]["rows_left"] == 3
    near = left.withColumn("v", F.col("v") + 0.01)
    assert {r["column_name"]: r["ok"] for r in compare_tables(left, near, "k", ["v", "n"]).collect()} == {"v": True, "n": True}
    far = left.withColumn("v", F.col("v") + 0.02)
    assert {r["column_name"]: r["ok"] for r in compare_tables(left, far, "k", ["v"]).collect()} == {"v": False}


def test_compare_tables_sees_keys_and_nulls(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    right = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "k string, v double")
    got = compare_tables(left, right, "k", ["v"]).first()
    assert (got["rows_left"], got["rows_right"], got["only_left"], got["only_right"], got["ok"]) == (2, 2, 1, 1, False)
    twice = compare_tables(left.unionByName(left), left, "k", ["v"]).first()
    assert (twice["rows_left"], twice["rows_right"], twice["repeated_keys"], twice["ok"]) == (4, 2, 2, False)
    nulled = left.withColumn("v", F.when(F.col("k") == "a", F.col("v")))
    got = compare_tables(left, nulled, "k", ["v"]).first()
    assert (got["null_mismatches"], got["ok"]) == (1, False)


def test_merge_totals_and_audit(spark):
    one = spark.createDataFrame([(1,)], "a int")
    two = spark.createDataFrame([("x", None)], "b string, c int")
    assert merge_totals(one, two).first().asDict() == {"a": 1, "b": "x", "c": None}
    with pytest.raises(ValueError):
        merge_totals(one, one)
    left = spark.createDataFrame([("x", 1), (None, 2)], "d string, a int")
    right = spark.createDataFrame([(None, 5), ("y", 6)], "d string, b int")
    assert rows(merge_groups(["d"], left, right)) == [("x", 1, None), ("y", None, 6), (None, 2, 5)]
    audit = load_audit({"one": one, "two": two, "three": one}, {"one": 1, "two": 5}).collect()
    assert {r["table_name"]: r["status"] for r in audit} == {"one": "PASS", "two": "FAIL", "three": None}


# calendar


def test_date_dimension_pads_whole_years(spark):
    df = spark.createDataFrame([(datetime(2016, 9, 4),), (datetime(2018, 9, 3),)], "t timestamp_ntz")
    dim = date_dimension(df, "t")
    assert dim.count() == 1096
    first = dim.orderBy("date").first()
    assert tuple(first) == (date(2016, 1, 1), 2016, 1, "Jan", "2016-01", "Q1", date(2016, 1, 1))
    assert date_dimension(df.limit(0), "t").count() == 0


MONTHS = [(date(2016, 10, 1), 100), (date(2016, 12, 1), 20), (date(2017, 1, 1), 30), (date(2017, 2, 1), 0), (date(2017, 3, 1), 9)]


def test_month_over_month_skips_a_gap(spark):
    df = spark.createDataFrame(MONTHS, "m date, v int")
    got = {r["m"]: (r["prior_v"], r["v_mom"]) for r in month_over_month(df, "m", "v").collect()}
    assert got == {
        date(2016, 10, 1): (None, None), date(2016, 12, 1): (None, None), date(2017, 1, 1): (20, 0.5),
        date(2017, 2, 1): (30, -1.0), date(2017, 3, 1): (0, None),
    }


def test_year_to_date_restarts(spark):
    df = spark.createDataFrame(MONTHS, "m date, v int")
    assert [r["v_ytd"] for r in year_to_date(df, "m", "v").orderBy("m").collect()] == [100, 120, 30, 30, 39]


def test_fill_months_per_group(spark):
    df = spark.createDataFrame(
        [("a", date(2016, 11, 1), 1), ("a", date(2017, 2, 1), 2), (None, date(2017, 1, 1), 3)], "d string, m date, v int"
    )
    got = rows(fill_months(df, "m", ["d"]))
    assert len(got) == 5
    assert ("a", date(2016, 12, 1), None) in got and (None, date(2017, 1, 1), 3) in got


# shares


def test_shares(spark):
    df = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20), ("d", 20)], "k string, v int")
    assert {r["k"]: r["v_share"] for r in share_of_total(df, "v").collect()}["a"] == pytest.approx(50 / 120)
    assert {r["k"]: r["v_scaled"] for r in scaled_to_max(df, "v").collect()}["b"] == 0.6
    assert [r["k"] for r in top_n(df, "v", "k", 3).collect()] == ["a", "b", "c"]
    top = cumulative_share(df, "v", "k", 3).orderBy("rank").collect()
    assert [r["k"] for r in top] == ["a", "b", "c"]
    assert [round(r["cumulative_share"], 6) for r in top] == [0.416667, 0.666667, 0.833333]
    assert [r["v_step"] for r in step_change(df.where("k < 'd'"), "k", "v").orderBy("k").collect()] == [None, -20, -10]


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 0)], "k string, v int")
    assert share_of_total(df, "v").first()["v_share"] is None


# statistics


def test_histograms(spark):
    df = spark.createDataFrame([(Decimal("0.00"), 1.0), (Decimal("49.99"), -0.5), (Decimal("50.00"), None), (None, 7.0)], "v decimal(12,2), d double")
    assert rows(histogram(df, F.col("v"), 50)) == [(0, 2), (50, 1)]
    pair = paired_histogram(df, {"a": F.col("d"), "b": F.col("d") + 5}, 5)
    assert rows(pair) == [(-5, 1, 0), (0, 1, 1), (10, 0, 1), (5, 1, 1)]


@pytest.mark.parametrize("n", [1, 2, 7, 200, 201])
def test_exact_median(spark, n):
    rng = random.Random(n)
    # a third of the values are equal, the rest spread over negative and positive days
    values = [86_400_000_000 * 3 if i % 3 == 0 else rng.randrange(-(10**12), 10**12) for i in range(n)]
    df = spark.createDataFrame([(v, "x" if i % 4 else None) for i, v in enumerate(values)] + [(None, "x")], "v long, g string")
    assert exact_median(df, F.col("v")).first()["median"] == statistics.median(values)
    got = {r["g"]: r["median"] for r in exact_median(df, F.col("v"), ["g"]).collect()}
    want = {}
    for g in ("x", None):
        mine = [v for i, v in enumerate(values) if ("x" if i % 4 else None) == g]
        if mine:
            want[g] = statistics.median(mine)
    assert got == want


def test_median_by_a_coarse_sketch(spark):
    """The bracket is wide where the sketch is coarse, and the median still exact, ties and groups of all sizes included."""
    rng = random.Random(5)
    rows = [(rng.choice([0, rng.randrange(10**9)]), g) for g, n in (("a", 20_000), ("b", 901), ("c", 3), (None, 5_000)) for _ in range(n)]
    df = spark.createDataFrame(rows, "v long, g string").repartition(7)
    got = {r["g"]: r["median"] for r in exact_median(df, F.col("v"), ["g"], accuracy=50).collect()}
    assert got == {g: statistics.median(v for v, h in rows if h == g) for g in ("a", "b", "c", None)}
    assert exact_median(df, F.col("v"), accuracy=50).first()["median"] == statistics.median(v for v, _ in rows)


def test_a_bracket_that_misses_is_an_error(spark):
    with pytest.raises(Exception, match="misses its middle"):
        # A bracket laid beside the middle.
        exact_median(spark.range(1000).repartition(4), F.col("id"), accuracy=10, margin=-2).collect()


def test_median_of_nothing(spark):
    nothing = spark.range(0)
    assert exact_median(nothing, F.col("id")).first()["median"] is None
    assert exact_median(nothing.withColumn("g", F.lit(1)), F.col("id"), ["g"]).collect() == []


def test_correlation(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0), (4, None)], "x int, y double")
    assert df.agg(correlation("x", "y").alias("r")).first()["r"] == pytest.approx(1.0)


# slicers and volume


def test_slicers(spark):
    df = spark.createDataFrame(
        [(datetime(2017, 1, 1), "SP", "Toys"), (datetime(2017, 1, 31, 23, 59, 59), "RJ", "Auto"), (datetime(2017, 2, 1), "SP", "Auto")],
        "order_purchase_timestamp timestamp_ntz, customer_state string, product_category string",
    )
    assert slice_rows(df).count() == 3
    assert slice_rows(df, "2017-01-01", "2017-01-31").count() == 2
    assert slice_rows(df, date_from="2017-01-02").count() == 2
    assert slice_rows(df, states=["SP"], categories=["Auto"]).count() == 1


def test_volume_filters_are_complements(spark):
    df = spark.createDataFrame([(49,), (50,), (51,)], "n int")
    assert rows(enough_volume(df, "n", 50)) == [(50,), (51,)]
    assert rows(enough_volume(df, "n", 50, strict=True)) == [(51,)]
    assert rows(too_little_volume(df, "n", 50, strict=True)) == [(49,), (50,)]
    assert rows(too_little_volume(df, "n", 50)) == [(49,)]
