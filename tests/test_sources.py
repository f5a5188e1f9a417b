"""Readers, quarantine, writers, views and the whole batch job."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from fixture_tables import CUSTOMERS, ITEMS, ORDERS, PAYMENTS, item, payment, raw_tables
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.operators.checks import ChecksFailed
from grainwise.operators.populations import slice_rows
from grainwise.plans import pipeline
from grainwise.schemas import SCHEMAS
from grainwise.sources import (
    land_parquet,
    load_parquet,
    oversized_files,
    quarantined,
    read_csv,
    read_jdbc,
    read_report,
    register_views,
    split_quarantine,
    write_fact,
    write_report,
    write_table,
)

REVIEWS = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    'r1,o1,5,ótimo,"first line\nsecond ""quoted"" line, with comma",2017-01-11 00:00:00,2017-01-12 10:20:30\n'
    'r2,o2,bad,,"ends in a backslash \\",2017-01-11 00:00:00,2017-01-12 10:20:30\n'
    "r3,o3,,,,2017-01-11 00:00:00,\n"
)


@pytest.fixture
def review_file(tmp_path):
    (tmp_path / "order_reviews.csv").write_text(REVIEWS, encoding="utf-8")
    return str(tmp_path)


def test_free_text_csv(spark, review_file):
    good, bad = split_quarantine(read_csv(spark, review_file, "order_reviews", keep_text=True))
    rows = {r["review_id"]: r for r in good.collect()}
    assert set(rows) == {"r1", "r3"}
    assert rows["r1"]["review_comment_title"] == "ótimo"
    assert rows["r1"]["review_comment_message"] == 'first line\nsecond "quoted" line, with comma'
    assert rows["r1"]["review_answer_timestamp"] == datetime(2017, 1, 12, 10, 20, 30)
    assert rows["r3"]["review_score"] is None and rows["r3"]["review_answer_timestamp"] is None
    rejected = bad.collect()
    assert [r["review_id"] for r in rejected] == ["r2"]
    assert "backslash" in rejected[0]["_corrupt_record"]


def test_review_text_is_not_read_by_default(spark, review_file):
    assert "review_comment_message" not in read_csv(spark, review_file, "order_reviews").columns


def test_declared_types_and_leading_zeros(spark, tmp_path):
    (tmp_path / "people.csv").write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,01409,são paulo,SP\n",
        encoding="utf-8",
    )
    row = read_csv(spark, str(tmp_path), "customers", {"customers": "people.csv"}).first()
    assert (row["customer_zip_code_prefix"], row["customer_city"]) == ("01409", "são paulo")


def test_byte_order_mark_and_header_check(spark, tmp_path):
    text = "product_category_name,product_category_name_english\nbeleza_saude,health_beauty\n"
    (tmp_path / "product_category_translation.csv").write_text(text, encoding="utf-8-sig")
    row = read_csv(spark, str(tmp_path), "product_category_translation").first()
    assert tuple(row) == ("beleza_saude", "health_beauty", None)
    (tmp_path / "order_reviews.csv").write_text(REVIEWS, encoding="utf-8-sig")
    assert read_csv(spark, str(tmp_path), "order_reviews").first()["review_id"] == "r1"
    swapped = "product_category_name_english,product_category_name\nhealth_beauty,beleza_saude\n"
    (tmp_path / "swapped.csv").write_text(swapped, encoding="utf-8")
    df = read_csv(spark, str(tmp_path), "product_category_translation", {"product_category_translation": "swapped.csv"})
    with pytest.raises(Exception, match="header"):
        df.collect()


def test_schemas_hold_money_as_decimals():
    assert SCHEMAS["order_items"]["price"].dataType == T.DecimalType(12, 2)
    assert SCHEMAS["orders"]["order_purchase_timestamp"].dataType == T.TimestampNTZType()


def write_csvs(raw, root):
    """The fixture as CSV files, one file per table."""
    for name, schema in SCHEMAS.items():
        df = raw.by_name()[name]
        lines = [",".join(schema.names)]
        for r in df.collect():
            lines.append(",".join("" if v is None else str(v) for v in r))
        (root / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_landing_keeps_every_row(spark, raw, tmp_path):
    write_csvs(raw, tmp_path)
    out = str(tmp_path / "landed")
    land_parquet(spark, str(tmp_path), out)
    landed = load_parquet(spark, out)
    assert landed.orders.count() == 6
    assert landed.order_items.agg({"price": "sum"}).first()[0] == Decimal(774)
    assert sorted(map(repr, landed.order_payments.collect())) == sorted(map(repr, raw.order_payments.collect()))
    assert quarantined(spark, out, "orders").count() == 0


def review_files(root, number):
    """A folder of review files, each with a record that holds line breaks and quotes."""
    root.mkdir()
    header, *_ = REVIEWS.split("\n")
    for n in range(number):
        rows = [f'r{n}_{k},o{n},{k % 5 + 1},,"first line\nsecond, ""quoted"" line {n}",2018-01-01 00:00:00,2018-01-02 00:00:00' for k in range(3)]
        (root / f"part-{n}.csv").write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")


def test_a_folder_of_review_files_is_read_by_as_many_tasks(spark, tmp_path):
    review_files(tmp_path / "reviews", 6)
    for name in ("reviews", "reviews/part-*.csv"):
        df = read_csv(spark, str(tmp_path), "order_reviews", {"order_reviews": name}, keep_text=True)
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() == 6
        good, bad = split_quarantine(df)
        assert (good.count(), bad.count()) == (18, 0)
        assert good.where("review_comment_message like '%\nsecond, \"quoted\" line%'").count() == 18


def test_long_review_files_are_landed_whole_and_warned_of(spark, raw, tmp_path):
    write_csvs(raw, tmp_path)
    review_files(tmp_path / "reviews", 3)
    with (tmp_path / "reviews" / "part-1.csv").open("a", encoding="utf-8") as f:
        f.write("".join(f"x{k},o1,5,,,2018-01-01 00:00:00,\n" for k in range(200)))
    files = {"order_reviews": "reviews"}
    assert [r["path"].rsplit("/", 1)[1] for r in oversized_files(spark, str(tmp_path), "order_reviews", files, 1000).collect()] == ["part-1.csv"]
    assert oversized_files(spark, str(tmp_path), "orders", None, 1).collect() == []
    with pytest.warns(UserWarning, match="part-1.csv holds [0-9]+ bytes, which one task") as caught:
        land_parquet(spark, str(tmp_path), str(tmp_path / "landed"), files, multiline_bytes=1000)
    assert len([w for w in caught if "one task" in str(w.message)]) == 1
    assert load_parquet(spark, str(tmp_path / "landed")).order_reviews.count() == 209


def test_rejected_records_are_kept_apart(spark, raw, tmp_path):
    write_csvs(raw, tmp_path)
    with (tmp_path / "order_items.csv").open("a", encoding="utf-8") as f:
        f.write("k10,3,w1,v1,2018-05-06 00:00:00,not money,1\n")
    out = str(tmp_path / "landed")
    land_parquet(spark, str(tmp_path), out)
    assert load_parquet(spark, out).order_items.count() == 10
    bad = quarantined(spark, out, "order_items").collect()
    assert [r["_corrupt_record"] for r in bad] == ["k10,3,w1,v1,2018-05-06 00:00:00,not money,1"]
    plan = load_parquet(spark, out).order_items._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rejected" in plan


def test_the_whole_job(spark, raw, tmp_path):
    write_csvs(raw, tmp_path)
    out = str(tmp_path / "out")
    land_parquet(spark, str(tmp_path), f"{out}/raw")
    marts = pipeline.run(spark, load_parquet(spark, f"{out}/raw"), out, payment_gap=0.31, unpaid_orders=1)
    assert marts.fct_order.count() == 6 and marts.fct_order_item.count() == 10
    assert marts.dim_product.count() == 3 and marts.dim_date.count() == 365
    assert spark.table("fct_order").count() == 6
    assert spark.table("v_monthly_sales").count() == 3
    naive = spark.sql(
        """select count(*) as n, sum(i.price + i.freight_value) as v from orders o
           join order_items i on i.order_id = o.order_id join order_payments p on p.order_id = o.order_id"""
    ).first()
    assert tuple(naive) == (13, Decimal(975))
    audit = {r["table_name"]: r["row_count"] for r in spark.read.parquet(f"{out}/reports/load_audit").collect()}
    assert audit["order_items"] == 10 and len(audit) == 8
    assert {r["status"] for r in spark.read.parquet(f"{out}/reports/constraints").collect()} == {"PASS"}
    pipeline.export_csv(marts, f"{out}/csv")
    assert spark.read.option("header", True).csv(f"{out}/csv/fct_order_item").count() == 10
    assert spark.read.parquet(f"{out}/reports/reconciliation").count() == 6
    schema = T.StructType(
        [
            T.StructField("order_month", T.DateType()),
            T.StructField("orders", T.LongType()),
            T.StructField("revenue", T.DecimalType(22, 2)),
            T.StructField("aov", T.DoubleType()),
            T.StructField("customers", T.LongType()),
        ]
    )
    months = read_report(spark, f"{out}/reports/monthly_sales", schema).collect()
    assert [r["order_month"] for r in months] == [date(2018, 5, 1), date(2018, 6, 1), date(2018, 7, 1)]


BOUNDS = {"payment_gap": 0.31, "unpaid_orders": 1}


def test_the_job_stops_on_grown_gaps(spark, raw, tmp_path):
    with pytest.raises(ChecksFailed, match="every order has a payment row") as stopped:
        pipeline.run(spark, raw_tables(spark), str(tmp_path / "out"), payment_gap=0.30, unpaid_orders=0)
    assert "payments equal order value" in str(stopped.value)
    assert spark.read.parquet(str(tmp_path / "out/reports/reconciliation")).count() == 6
    assert {r["ok"] for r in spark.read.parquet(str(tmp_path / "out/reports/comparisons")).collect()} == {True}
    assert spark.read.parquet(str(tmp_path / "out/diagnostics/order_fanout")).first()["naive_rows"] == 13
    assert spark.read.parquet(str(tmp_path / "out/pages/repeat_rate")).first()["customers"] == 3


def test_rejected_records_stop_the_job_unless_allowed(spark, raw, tmp_path):
    write_csvs(raw, tmp_path)
    for name, bad in (("order_items", "k10,3,w1,v1,2018-05-06 00:00:00,1 000.00,1"), ("order_payments", "k10,2,voucher,x,5.00")):
        with (tmp_path / f"{name}.csv").open("a", encoding="utf-8") as f:
            f.write(bad + "\n")
    out = str(tmp_path / "out")
    land_parquet(spark, str(tmp_path), f"{out}/raw")
    landed = load_parquet(spark, f"{out}/raw")
    with pytest.raises(ChecksFailed) as stopped:
        pipeline.run(spark, landed, out, **BOUNDS)
    assert "load of order_items" in str(stopped.value) and "load of order_payments" in str(stopped.value)
    assert "10 rows, 1 rejected" in str(stopped.value)
    pipeline.run(spark, landed, out, **BOUNDS, reject_allowance=1)
    audit = {r["table_name"]: r for r in spark.read.parquet(f"{out}/reports/load_audit").collect()}
    assert (audit["order_items"]["row_count"], audit["order_items"]["rejected"], audit["order_items"]["records"]) == (10, 1, 11)


def test_whole_numbers_with_a_fraction_of_zeros(spark, raw, tmp_path):
    write_csvs(raw, tmp_path)
    header = ",".join(SCHEMAS["products"].names)
    lines = [header, "w1,moveis_escritorio,40.0,10,1.0,850.0,,,", "w2,livros_tecnicos,40.5,10,1,320.0,,,", "w3,,,,,75.0,,,"]
    (tmp_path / "products.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    out = str(tmp_path / "landed")
    land_parquet(spark, str(tmp_path), out)
    kept = {r["product_id"]: r for r in load_parquet(spark, out).products.collect()}
    assert set(kept) == {"w1", "w3"}
    assert (kept["w1"]["product_name_lenght"], kept["w1"]["product_photos_qty"], kept["w3"]["product_name_lenght"]) == (40, 1, None)
    bad = quarantined(spark, out, "products").collect()
    assert [r["product_id"] for r in bad] == ["w2"] and "40.5" in bad[0]["_corrupt_record"]


@pytest.mark.parametrize(
    ("changed", "message"),
    [
        ({"customers": [*CUSTOMERS, CUSTOMERS[0]]}, "customers primary_key customer_id"),
        ({"items": [*ITEMS, item("k10", 3, "ghost", "nobody", 1, 0)]}, "order_items foreign_key product_id"),
        ({"payments": [*PAYMENTS, payment(None, 1, "voucher", 1, 1)]}, "order_payments not_null order_id"),
    ],
)
def test_broken_promises_stop_the_job(spark, tmp_path, changed, message):
    with pytest.raises(ChecksFailed, match=message):
        pipeline.run(spark, raw_tables(spark, **changed), str(tmp_path / "out"), **BOUNDS)


def test_empty_and_undated_inputs_run_through(spark, tmp_path):
    undated = [{**o, "order_purchase_timestamp": None} for o in ORDERS]
    for name, changed in (("no items", {"items": []}), ("undated", {"orders": undated})):
        out = str(tmp_path / name)
        with pytest.raises(ChecksFailed):  # the gap grew, or a promised date is missing
            pipeline.run(spark, raw_tables(spark, **changed), out, **BOUNDS)
        assert spark.read.parquet(f"{out}/reports/reconciliation").count() == 6


def test_a_broken_helper_shows_in_the_comparison(spark, raw, monkeypatch):
    from pyspark.sql import functions as F

    from grainwise.plans import marts
    from grainwise.plans.marts import build_fct_order
    from grainwise.plans.reconciliation import compare_headline

    assert {r["ok"] for r in compare_headline(raw, build_fct_order(raw)).collect()} == {True}
    monkeypatch.setattr(marts, "reviews_by_order", lambda reviews, columns: reviews.groupBy("order_id").agg(F.max("review_score").alias("review_score")))
    assert False in {r["ok"] for r in compare_headline(raw, build_fct_order(raw)).collect()}


def test_the_command_line(spark, raw, tmp_path):
    write_csvs(raw, tmp_path)
    (tmp_path / "orders.csv").rename(tmp_path / "the_orders_dataset.csv")
    out = str(tmp_path / "out")
    common = [str(tmp_path), out, "--file", "orders=the_orders_dataset.csv", "--payment-gap", "0.31", "--unpaid-orders", "1"]
    pipeline.main([*common, "--expected", "orders=6"])
    assert spark.read.schema("order_id string").parquet(f"{out}/marts/fct_order").count() == 6
    with pytest.raises(ChecksFailed, match="load of orders: expected 7 rows, got 6 rows"):
        pipeline.main([*common, "--expected", "orders=7"])


def test_fact_files_are_pruned_by_month(spark, raw, tmp_path):
    from grainwise.plans.marts import build_fct_order

    path = str(tmp_path / "fct")
    write_fact(build_fct_order(raw), path)
    back = spark.read.parquet(path)
    assert back.count() == 6
    one = back.where("order_month = date'2018-06-01'")
    assert len(one.inputFiles()) >= 1 and one.first()["order_id"] == "k12"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    sliced = slice_rows(back, "2018-06-05", "2018-06-30")
    assert [r["order_id"] for r in sliced.collect()] == ["k12"]
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "(order_month#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_writers_and_views(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    write_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    write_report(df.orderBy("id"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    register_views({"a_view": df})
    assert spark.sql("select count(*) from a_view").first()[0] == 2


class Recorder:
    """Stands in for a reader: no database is opened in a test."""

    def __init__(self):
        self.read, self.seen = self, {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **kw):
        self.seen.update(kw)
        return self

    def load(self):
        return self.seen


def test_jdbc_scan_is_split():
    seen = read_jdbc(Recorder(), "jdbc:x", "orders", "id", (1, 900), 8, user="u")
    assert (seen["format"], seen["dbtable"], seen["user"]) == ("jdbc", "orders", "u")
    assert (seen["partitionColumn"], seen["lowerBound"], seen["upperBound"], seen["numPartitions"]) == ("id", "1", "900", "8")
    with pytest.raises(ValueError):
        read_jdbc(Recorder(), "jdbc:x", "orders", "id")
