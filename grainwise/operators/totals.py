"""Combine totals of several tables without a join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_groups(dims: Sequence[str], *grouped: DataFrame) -> DataFrame:
    """One table with the measures of several tables grouped by the same ``dims``.

    The rows are stacked with NULL in the measures they lack and folded with
    ``max``, which ignores NULL; each measure has a value in one row of a
    group only. Unlike a join this matches NULL dimensions, keeps groups that
    one table lacks, and needs no key at all when there are no dimensions.
    """
    names = [c for df in grouped for c in df.columns if c not in dims]
    if len(names) != len(set(names)):
        raise ValueError("merged tables must not share measure names")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), grouped)
    return stacked.groupBy(*dims).agg(*[F.max(c).alias(c) for c in names])


def merge_totals(*one_row: DataFrame) -> DataFrame:
    """One row holding the columns of all the given one-row tables."""
    return merge_groups((), *one_row)


def grand_totals(df: DataFrame, **aggregates) -> DataFrame:
    """Key-less aggregate of one table."""
    return df.agg(*[c.alias(name) for name, c in aggregates.items()])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table as ``(table_name, row_count)``."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def load_audit(
    tables: dict[str, DataFrame],
    expected: dict[str, int] | None = None,
    rejected: dict[str, DataFrame] | None = None,
    allowance: int = 0,
) -> DataFrame:
    """Row counts beside the expected ones, and how many records of each table were rejected.

    A table fails when its count differs from the expected one, or when more
    than ``allowance`` of its records were rejected. Status is NULL where
    nothing is expected and nothing known of rejects. ``records`` counts what
    was read: rows and rejects.
    """
    expected, rejected = expected or {}, rejected or {}
    want = F.lit(None).cast("long")
    for name, n in expected.items():
        want = F.when(F.col("table_name") == name, F.lit(n).cast("long")).otherwise(want)
    counted = row_counts(tables)
    if rejected:
        lost = row_counts(rejected).withColumnRenamed("row_count", "rejected")
        counted = merge_groups(["table_name"], counted, lost)
    else:
        counted = counted.withColumn("rejected", F.lit(None).cast("long"))
    counted = counted.withColumn("records", F.col("row_count") + F.coalesce("rejected", F.lit(0)))
    counted = counted.withColumn("expected", want)
    off = F.coalesce(F.col("row_count") != F.col("expected"), F.lit(False))
    spoilt = F.coalesce(F.col("rejected") > allowance, F.lit(False))
    known = F.col("expected").isNotNull() | F.col("rejected").isNotNull()
    return counted.withColumn("status", F.when(off | spoilt, "FAIL").when(known, "PASS"))
