"""Reconciliation checks, table comparison and the gate that fails a job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grain import as_list


MOST_NAMED = 1000


class ChecksFailed(RuntimeError):
    """Raised by :func:`require_no_failures`."""


@dataclass(frozen=True)
class Check:
    """One comparison over a one-row table of totals.

    ``known_gap`` marks a difference the data really has: it is reported as
    KNOWN GAP, not hidden by a wider tolerance. ``gap_bound`` states how far
    that difference may go before it counts as a failure after all.
    """

    name: str
    expected: Column
    actual: Column
    ok: Column
    note: Column | str
    known_gap: bool = False
    gap_bound: Column | None = None


def check_status(check: Check) -> Column:
    ok = F.coalesce(check.ok, F.lit(False))
    if not check.known_gap:
        return F.when(ok, "PASS").otherwise("FAIL")
    if check.gap_bound is None:
        return F.when(ok, "PASS").otherwise("KNOWN GAP")
    within = F.coalesce(check.gap_bound, F.lit(False))
    return F.when(ok, "PASS").when(within, "KNOWN GAP").otherwise("FAIL")


def run_checks(totals: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``(ord, check, status, expected, actual, note)`` from a one-row table."""
    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(c.name).alias("check"),
            check_status(c).alias("status"),
            c.expected.cast("string").alias("expected"),
            c.actual.cast("string").alias("actual"),
            (F.lit(c.note) if isinstance(c.note, str) else c.note).alias("note"),
        )
        for i, c in enumerate(checks, start=1)
    ]
    return totals.select(F.inline(F.array(*rows)))


def with_status(checks: DataFrame, *statuses: str) -> DataFrame:
    """Check rows in the given states, e.g. those whose note must be read."""
    return checks.where(F.col("status").isin(*statuses))


def require_no_failures(checks: DataFrame) -> None:
    """Raise when any check failed; the table has one row per declared check."""
    failed = with_status(checks, "FAIL").select("check", "expected", "actual").limit(MOST_NAMED).collect()
    if failed:
        lines = [f"{r['check']}: expected {r['expected']}, got {r['actual']}" for r in failed]
        raise ChecksFailed("; ".join(lines))


def compare_tables(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    values: Sequence[str],
    tolerance: float = 0.011,
) -> DataFrame:
    """Align two tables on their keys and measure every value column.

    One row per value column. A key present on one side only, a key that
    occurs twice and a value that is NULL on one side only all count against
    ``ok``. Each side is collapsed to its keys first, so repeated keys are
    reported and never multiply each other.
    """
    keys = as_list(keys)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias(f"_{tag}k_{k}") for k in keys]).agg(
            F.count("*").alias(f"_{tag}_rows"), *[F.max(v).alias(f"_{tag}_{v}") for v in values]
        )

    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"_lk_{k}").eqNullSafe(F.col(f"_rk_{k}"))
    both = side(left, "l").join(side(right, "r"), same_key, "full")
    n_left, n_right = F.col("_l_rows"), F.col("_r_rows")
    matched = n_left.isNotNull() & n_right.isNotNull()

    def rows_where(n: Column, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    aggregates = [
        rows_where(n_left, F.lit(True)).alias("rows_left"),
        rows_where(n_right, F.lit(True)).alias("rows_right"),
        rows_where(n_left, n_right.isNull()).alias("only_left"),
        rows_where(n_right, n_left.isNull()).alias("only_right"),
        F.count_if((n_left > 1) | (n_right > 1)).alias("repeated_keys"),
    ]
    for v in values:
        lv, rv = F.col(f"_l_{v}"), F.col(f"_r_{v}")
        aggregates.append(F.count_if(matched & (lv.isNull() != rv.isNull())).alias(f"_n_{v}"))
        aggregates.append(F.max(F.abs(lv.cast("double") - rv.cast("double"))).alias(f"_d_{v}"))
    measured = both.agg(*aggregates)
    aligned = (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("repeated_keys") == 0)
    rows = [
        F.struct(
            F.lit(v).alias("column_name"),
            *[F.col(c) for c in ("rows_left", "rows_right", "only_left", "only_right", "repeated_keys")],
            F.col(f"_n_{v}").alias("null_mismatches"),
            F.col(f"_d_{v}").alias("max_abs_delta"),
            (aligned & (F.col(f"_n_{v}") == 0) & (F.coalesce(F.col(f"_d_{v}"), F.lit(0.0)) <= tolerance)).alias("ok"),
        )
        for v in values
    ]
    return measured.select(F.inline(F.array(*rows)))
