"""Bring fan-out tables to the grain of their parent.

Everything here is an aggregate with a map-side partial step, so a key that
holds a large share of the rows reaches the shuffle as one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def as_list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def collapse(df: DataFrame, keys: Keys, aggregates: Mapping[str, Column]) -> DataFrame:
    """One row per key: the only shape in which a child may join its parent."""
    return df.groupBy(*as_list(keys)).agg(*[c.alias(name) for name, c in aggregates.items()])


def top_by(value: Column, *order: Column) -> Column:
    """Aggregate: ``value`` from the row with the highest ``order``.

    NULL sorts lowest, so a row with a known order value always wins.
    """
    return F.max_by(value, F.struct(*order))


def keep_latest(
    df: DataFrame,
    keys: Keys,
    order_cols: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The last row per key by ``order_cols``; a NULL order value loses.

    ``order_cols`` must end in a column that breaks every tie, or two equal
    rows may be told apart only by chance. An aggregate rather than
    ``row_number``: it needs no sort of the whole group in one task, and a
    left join against it is dropped by the optimizer when no column is used.
    """
    keys = as_list(keys)
    kept = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*kept), F.struct(*order_cols)).alias("_latest")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in kept])


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and surplus rows of a table that has no unique key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(key).alias("distinct_keys"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_per_key"),
    )
