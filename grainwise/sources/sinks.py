"""Writers for facts, dimensions and small report tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_fact(df: DataFrame, path: str, partition: str = "order_month") -> None:
    """Write a fact partitioned by month.

    The rebalance hint gathers each month into few files and, unlike a plain
    repartition, lets the adaptive planner split a month that is too large
    for one task.
    """
    df.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    writer.save(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for aggregated tables of one row per group."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def register_views(views: Mapping[str, DataFrame]) -> None:
    """Expose tables to SQL under their names; nothing is computed."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
