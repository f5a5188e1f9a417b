"""Declared keys and domains as check jobs; Spark tables do not enforce them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grain import as_list


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableRules:
    """What one table promises about its rows."""

    key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    # column -> (low, high), both allowed; NULL passes
    between: Mapping[str, tuple] = field(default_factory=dict)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a key would reject: all but one per value, and any with a NULL in it."""
    keys = as_list(keys)
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    has_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    surplus = F.when(has_null, F.col("_n")).otherwise(F.col("_n") - 1)
    return per_key.agg(F.coalesce(F.sum(surplus), F.lit(0)).alias("violations"))


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Foreign keys without a parent, with the rows that use them.

    The child is counted per key first, so a popular parent costs one row in
    the join and not one per child.
    """
    used = (
        child.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("key"))
        .agg(F.count("*").alias("child_rows"))
    )
    return used.join(parent.select(F.col(parent_column).alias("key")), "key", "left_anti")


def _labels(rules: TableRules) -> dict[str, tuple[str, str]]:
    """(rule, columns) of everything one pass over a table measures, by the name of its count."""
    found = {f"_null_{c}": ("not_null", c) for c in rules.not_null}
    return found | {f"_range_{c}": ("between", c) for c in rules.between}


def _row_counts(rules: TableRules) -> list[Column]:
    # As SQL text: wide tables have many rules, and every call on a column is a round trip to the JVM.
    counts = [F.expr(f"count_if(`{c}` is null) as `_null_{c}`") for c in rules.not_null]
    return counts + [F.count_if(~F.col(c).between(low, high)).alias(f"_range_{c}") for c, (low, high) in rules.between.items()]


def _totals(names: Sequence[str]) -> list[Column]:
    return [F.expr(f"coalesce(sum(`{n}`), 0) as `{n}`") for n in names]


def _one_pass(df: DataFrame, rules: TableRules, parents: Mapping[str, DataFrame]) -> DataFrame | None:
    """``(rule, columns, violations)`` of the key, its foreign keys, domains and nulls, from one scan.

    Rows are collapsed to the key, and each key carries how many of them break a domain or hold a
    null. A foreign key that is part of the key goes on from there: the same rows are
    collapsed once more to its column, which meets the parent's keys.
    """
    labels = _labels(rules)
    counts = _row_counts(rules)
    if not rules.key:
        if not counts:
            return None
        return _as_rows(df.agg(*counts), labels)
    keys = as_list(rules.key)
    has_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    surplus = F.when(has_null, F.col("_n")).otherwise(F.col("_n") - 1)
    found = df.groupBy(*keys).agg(F.count("*").alias("_n"), *counts).withColumn("_key", surplus)
    labels = {"_key": ("primary_key", ",".join(keys))} | labels
    for fk in rules.foreign_keys:
        if fk.column not in keys:
            continue
        names = list(labels)
        known = parents[fk.parent].select(F.col(fk.parent_column).alias(fk.column)).distinct().withColumn("_known", F.lit(True))
        if len(keys) > 1:
            found = found.groupBy(*_left(keys, fk, rules)).agg(F.sum("_n").alias("_n"), *_totals(names))
            keys = _left(keys, fk, rules)
        orphaned = F.col("_known").isNull() & F.col(fk.column).isNotNull()
        found = found.join(known, fk.column, "left").withColumn(f"_fk_{fk.column}", F.when(orphaned, F.col("_n")).otherwise(0)).drop("_known")
        labels[f"_fk_{fk.column}"] = ("foreign_key", fk.column)
    return _as_rows(found.agg(*_totals(list(labels))), labels)


def _left(keys: Sequence[str], fk: ForeignKey, rules: TableRules) -> list[str]:
    """Columns to collapse to before ``fk`` meets its parent: its own, and those of the foreign keys after it."""
    later = rules.foreign_keys[rules.foreign_keys.index(fk) :]
    return [k for k in keys if k in {f.column for f in later}]


def _as_rows(measured: DataFrame, labels: Mapping[str, tuple[str, str]]) -> DataFrame:
    rows = [f"struct('{rule}' as rule, '{columns}' as columns, `{name}` as violations)" for name, (rule, columns) in labels.items()]
    return measured.selectExpr(f"inline(array({', '.join(rows)}))")


def constraint_report(tables: Mapping[str, DataFrame], rules: Mapping[str, TableRules]) -> DataFrame:
    """``(table_name, rule, columns, violations, status)`` for every declared rule.

    A table is scanned once for its key, domains, nulls and the foreign keys in its key,
    and once for every other foreign key.
    """
    parts = []
    for name, rule in rules.items():
        df = tables[name]
        found = [_one_pass(df, rule, tables)]
        for fk in rule.foreign_keys:
            if fk.column in rule.key:
                continue
            orphans = orphan_keys(df, fk.column, tables[fk.parent], fk.parent_column).agg(
                F.coalesce(F.sum("child_rows"), F.lit(0)).alias("violations")
            )
            found.append(orphans.select(F.lit("foreign_key").alias("rule"), F.lit(fk.column).alias("columns"), "violations"))
        parts += [f.select(F.lit(name).alias("table_name"), "rule", "columns", "violations") for f in found if f is not None]
    status = F.when(F.col("violations") == 0, "PASS").otherwise("FAIL")
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)
