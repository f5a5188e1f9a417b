"""The batch job: raw tables in, marts, checks and reports out."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calendar import date_dimension
from ..operators.checks import require_no_failures
from ..operators.totals import load_audit
from ..session import RECOMMENDED
from ..sources.readers import RawTables, land_parquet, load_parquet
from ..sources.sinks import register_views, write_fact, write_report, write_table
from . import metrics, pages
from .marts import (
    build_dim_customer,
    build_dim_product,
    build_dim_seller,
    build_fct_order,
    build_fct_order_item,
    items_by_order,
    payments_by_order,
    reviews_by_order,
)
from .reconciliation import additivity, comparisons, order_fanout, orders_without_review, raw_constraints, reconcile
from .reports import headline_from_raw, report_tables


@dataclass(frozen=True)
class Marts:
    fct_order: DataFrame
    fct_order_item: DataFrame
    dim_product: DataFrame
    dim_customer: DataFrame
    dim_seller: DataFrame
    dim_date: DataFrame


def write_marts(spark: SparkSession, raw: RawTables, root: str) -> Marts:
    """Write facts and dimensions, each built once, and read them back.

    The item fact and everything later start from the stored order fact: a
    lost executor costs a re-read of files and not a rebuild from raw.
    """
    schemas = {}

    def stored(name: str, df: DataFrame, write=write_table) -> DataFrame:
        write(df, f"{root}/{name}")
        schemas[name] = df.schema
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    fct_order = stored("fct_order", build_fct_order(raw), write_fact)
    stored("fct_order_item", build_fct_order_item(raw, fct_order=fct_order), write_fact)
    stored("dim_product", build_dim_product(raw.products, raw.category_translation))
    stored("dim_customer", build_dim_customer(raw))
    stored("dim_seller", build_dim_seller(raw))
    stored("dim_date", date_dimension(fct_order, "order_purchase_timestamp"))
    return read_marts(spark, root, schemas)


def read_marts(spark: SparkSession, root: str, schemas: dict[str, T.StructType]) -> Marts:
    """The stored marts, with the schemas they were written with: an empty or undated fact holds no file to infer one from."""
    return Marts(**{name: spark.read.schema(schemas[name]).parquet(f"{root}/{name}") for name in Marts.__dataclass_fields__})


def export_csv(marts: Marts, root: str) -> None:
    """CSV copies of every mart and dimension, for tools that read nothing else."""
    for name, df in vars(marts).items():
        write_table(df, f"{root}/{name}", "csv")


def sql_views(raw: RawTables, marts: Marts) -> dict[str, DataFrame]:
    """Raw tables, marts and reports under the names SQL users know them by."""
    reports = report_tables(marts.fct_order, marts.fct_order_item)
    return {
        **raw.by_name(),
        **vars(marts),
        "v_reviews_deduped": reviews_by_order(raw.order_reviews),
        "v_items_by_order": items_by_order(raw),
        "v_payments_by_order": payments_by_order(raw.order_payments),
        **{f"v_{name}": df for name, df in reports.items()},
    }


def gate(audit: DataFrame, constraints: DataFrame, checks: DataFrame, compared: DataFrame) -> DataFrame:
    """Every verdict of a run as (check, status, expected, actual)."""

    def rows(df: DataFrame, check: Column, status: Column, expected: Column, actual: Column) -> DataFrame:
        text = (c.cast("string").alias(n) for c, n in ((expected, "expected"), (actual, "actual")))
        return df.select(check.alias("check"), status.alias("status"), *text)

    counted = F.concat_ws("", F.col("row_count"), F.lit(" rows, "), F.coalesce("rejected", F.lit(0)), F.lit(" rejected"))
    wanted = F.concat_ws("", F.coalesce(F.col("expected").cast("string"), F.lit("any number of")), F.lit(" rows"))
    rule = F.concat_ws(" ", "table_name", "rule", "columns")
    differs = F.concat_ws("", F.lit("only left "), "only_left", F.lit(", only right "), "only_right", F.lit(", repeated "),
                          "repeated_keys", F.lit(", null "), "null_mismatches", F.lit(", delta "), "max_abs_delta")
    parts = [
        rows(audit, F.concat(F.lit("load of "), "table_name"), F.col("status"), wanted, counted),
        rows(constraints, rule, F.col("status"), F.lit(0), F.col("violations")),
        rows(checks, F.col("check"), F.col("status"), F.col("expected"), F.col("actual")),
        rows(compared, F.concat_ws(" ", F.lit("raw"), "report", "column_name"), F.when(F.col("ok"), "PASS").otherwise("FAIL"), F.lit("equal"), differs),
    ]
    return reduce(DataFrame.unionByName, parts)


def diagnostics(raw: RawTables, marts: Marts) -> dict[str, DataFrame]:
    """Small tables that explain a run; none of them stops it."""
    return {
        "grain_check": metrics.grain_check(marts.fct_order),
        "tie_out": metrics.tie_out(marts.fct_order, marts.fct_order_item),
        "additivity": additivity(marts.fct_order, marts.fct_order_item),
        "order_fanout": order_fanout(raw),
        "review_coverage": orders_without_review(raw),
        "headline_from_raw": headline_from_raw(raw),
    }


def page_tables(marts: Marts) -> dict[str, DataFrame]:
    """The datasets behind the dashboard's pages."""
    order, item = marts.fct_order, marts.fct_order_item
    of_order = (
        pages.kpi_cards, pages.revenue_by_month_with_mom, pages.revenue_by_state, pages.aov_trend, pages.items_per_order_distribution,
        pages.payment_mix, pages.monthly_trend, pages.dropped_months, pages.peak_month, pages.repeat_rate, pages.late_trend,
        pages.bucket_steps, pages.state_table, pages.state_drivers, pages.late_one_star_share, pages.counterfactual_gap,
        pages.growth_inputs, pages.median_delivery, pages.order_value_distribution, pages.delivery_distribution,
    )
    of_item = (
        pages.category_drivers, pages.category_lateness_split, pages.category_table, pages.category_treemap,
        pages.category_concentration, pages.price_vs_review,
    )
    return {f.__name__: f(order) for f in of_order} | {f.__name__: f(item) for f in of_item}


def run(
    spark: SparkSession,
    raw: RawTables,
    out: str,
    payment_gap: float,
    unpaid_orders: int,
    expected_rows: dict[str, int] | None = None,
    reject_allowance: int = 0,
) -> Marts:
    """Build, check and report everything; raises when anything failed.

    ``payment_gap`` and ``unpaid_orders`` bound the two gaps the data is known
    to have. Tables are written first, so a failed run can be read; then one
    gate goes over loads and rejected records, constraints, reconciliation and
    the comparisons with the raw tables. Every step after the marts starts from
    their files.
    """
    audit = load_audit(raw.by_name(), expected_rows, raw.rejected, reject_allowance)
    verdicts = {"load_audit": audit, "constraints": raw_constraints(raw)}
    marts = write_marts(spark, raw, f"{out}/marts")
    register_views(sql_views(raw, marts))
    reports = report_tables(marts.fct_order, marts.fct_order_item)
    verdicts["reconciliation"] = reconcile(raw, marts.fct_order, marts.fct_order_item, payment_gap, unpaid_orders)
    verdicts["comparisons"] = comparisons(raw, reports)
    for name, df in verdicts.items():
        write_table(df.coalesce(1), f"{out}/reports/{name}")
    for name, report in reports.items():
        write_report(report, f"{out}/reports/{name}")
    for folder, tables in (("diagnostics", diagnostics(raw, marts)), ("pages", page_tables(marts))):
        for name, df in tables.items():
            write_table(df.coalesce(1), f"{out}/{folder}/{name}")
    stored = {name: spark.read.schema(df.schema).parquet(f"{out}/reports/{name}") for name, df in verdicts.items()}
    write_report(stored["reconciliation"].orderBy("ord"), f"{out}/reports/reconciliation_csv")
    require_no_failures(gate(*stored.values()))
    return marts


def _pairs(values: list[str]) -> dict[str, str]:
    return dict(v.split("=", 1) for v in values)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Build marts and reports from the raw CSV tables.")
    parser.add_argument("csv_root")
    parser.add_argument("out")
    parser.add_argument("--file", action="append", default=[], metavar="TABLE=NAME", help="file of a table, if not TABLE.csv")
    parser.add_argument("--expected", action="append", default=[], metavar="TABLE=ROWS", help="rows that a table must have")
    parser.add_argument("--payment-gap", type=float, required=True, help="greatest share by which payments may differ from order value")
    parser.add_argument("--unpaid-orders", type=int, required=True, help="greatest number of orders without a payment")
    parser.add_argument("--rejects", type=int, default=0, help="records of a table that may be rejected")
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("grainwise")
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    land_parquet(spark, args.csv_root, f"{args.out}/raw", _pairs(args.file))
    expected = {table: int(n) for table, n in _pairs(args.expected).items()}
    raw = load_parquet(spark, f"{args.out}/raw")
    run(spark, raw, args.out, args.payment_gap, args.unpaid_orders, expected, args.rejects)


if __name__ == "__main__":
    main()
