"""How much would joining several children to a parent overstate each of them?"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rounded
from .totals import merge_totals


@dataclass(frozen=True)
class Child:
    """A fan-out table: its rows, the parent key in it, and the measure to sum."""

    rows: DataFrame
    key: str
    measure: Column


def fanout_report(parent: DataFrame, parent_key: str, children: Mapping[str, Child]) -> DataFrame:
    """One row: naive join size and, per child, true and inflated sums.

    For a key with ``n`` rows in one child and ``m`` in another the naive join
    holds ``n * m`` rows and repeats every value of the first child ``m``
    times. Both follow from the collapsed children, so the blown-up join is
    never built: the work is linear in the input whatever the fan-out.
    """
    names = list(children)
    joined = parent.groupBy(F.col(parent_key).alias("_key")).agg(F.count("*").alias("_parents"))
    true_sums = []
    for name, child in children.items():
        per_key = child.rows.groupBy(F.col(child.key).alias("_key")).agg(
            F.count("*").alias(f"_n_{name}"), F.sum(child.measure).alias(f"_v_{name}")
        )
        joined = joined.join(per_key, "_key", "inner")
        true_sums.append(child.rows.agg(F.sum(child.measure).alias(f"true_{name}")))

    def repeats(skip: str | None = None) -> Column:
        factor = F.col("_parents")
        for other in names:
            if other != skip:
                factor = factor * F.col(f"_n_{other}")
        return factor

    inflated = joined.agg(
        F.coalesce(F.sum(repeats()), F.lit(0)).alias("naive_rows"),
        *[F.sum(F.col(f"_v_{n}") * repeats(n)).alias(f"naive_{n}") for n in names],
    )
    totals = merge_totals(parent.agg(F.count("*").alias("parent_rows")), inflated, *true_sums)
    pct = [
        rounded(
            F.try_divide(F.col(f"naive_{n}").cast("double"), F.col(f"true_{n}").cast("double")) * 100 - 100, 1
        ).alias(f"pct_{n}_overstated")
        for n in names
    ]
    return totals.select("*", *pct)
