"""Distribution summaries that stay distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def histogram(df: DataFrame, value: Column, width: int, name: str = "bin_start") -> DataFrame:
    """Rows per fixed-width bin ``[start, start + width)``; NULL values are left out."""
    start = (F.floor(value / F.lit(width)) * F.lit(width)).cast("long")
    return df.where(value.isNotNull()).groupBy(start.alias(name)).agg(F.count("*").alias("row_count"))


def paired_histogram(df: DataFrame, values: dict[str, Column], width: int, name: str = "bin_start") -> DataFrame:
    """Several measures counted on one common set of bins, in one pass."""
    tagged = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()]))
    stacked = df.select(tagged.alias("x")).where(F.col("x.v").isNotNull())
    start = (F.floor(F.col("x.v") / F.lit(width)) * F.lit(width)).cast("long")
    return stacked.groupBy(start.alias(name)).agg(
        *[F.count_if(F.col("x.k") == k).alias(k) for k in values]
    )


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; rows with a NULL are skipped, and without spread there is none."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


# A sketch of this accuracy misses a rank by at most this share of a group's values.
MEDIAN_ACCURACY = 10_000
# How many times that error the bracket reaches to either side of the middle.
MEDIAN_MARGIN = 4


def exact_median(
    df: DataFrame,
    value: Column,
    dims: Sequence[str] = (),
    name: str = "median",
    accuracy: int = MEDIAN_ACCURACY,
    margin: int = MEDIAN_MARGIN,
) -> DataFrame:
    """Exact median of an integer-valued column, overall or per group.

    The built-in exact median keeps every distinct value of a group in one
    task. Here a quantile sketch of bounded size finds two values of each group
    that the middle ranks lie between, far enough apart for the sketch's error.
    A second pass counts exactly: what lies below the bracket and above it is one
    row per task and group, and only the values inside, a share of about 2 * ``margin`` /
    ``accuracy``, are shuffled and ranked one by one. Should a bracket ever miss a
    middle rank, the query fails and returns no wrong median.

    Values must be whole numbers below 2**53, which a sketch holds exactly.
    """
    dims = list(dims)
    rows = df.where(value.isNotNull()).select(*dims, value.cast("long").alias("_v"))
    reach = margin / accuracy
    ends = F.percentile_approx("_v", F.array(F.lit(0.5 - reach), F.lit(0.5 + reach)), accuracy)
    brackets = rows.groupBy(*[F.col(d).alias(f"_b_{d}") for d in dims]).agg(ends.alias("_ends"))
    brackets = brackets.select(*[f"_b_{d}" for d in dims], F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))
    if dims:
        same = F.lit(True)
        for d in dims:
            same = same & F.col(d).eqNullSafe(F.col(f"_b_{d}"))
        rows = rows.join(brackets, same)
    else:
        # One row by construction.
        ends = brackets.select(F.struct("_low", "_high")).scalar()
        rows = rows.withColumn("_ends", ends).select("_v", F.col("_ends._low").alias("_low"), F.col("_ends._high").alias("_high"))
    # -1 below the bracket, 0 inside, 1 above; only inside does the value tell rows apart.
    zone = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    inside = F.when(zone == 0, F.col("_v"))
    counts = rows.groupBy(*dims, zone.alias("_zone"), inside.alias("_at")).agg(F.count("*").alias("_n"))

    group = Window.partitionBy(*dims)
    upto = F.sum("_n").over(group.orderBy("_zone", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.select("*", upto.alias("_upto"), F.sum("_n").over(group).alias("_total"))
    first, second = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)

    def holds(rank: Column) -> Column:
        return (F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))

    middle = ranked.where(holds(first) | holds(second))
    picked = middle.groupBy(*dims).agg(
        F.sum(F.when(holds(first), F.col("_at")).otherwise(0)).alias("_first"),
        F.sum(F.when(holds(second), F.col("_at")).otherwise(0)).alias("_second"),
        F.count_if(F.col("_zone") != 0).alias("_missed"),
    )
    missed = F.raise_error(F.lit("the bracket of a median misses its middle ranks")).cast("double")
    median = F.when(F.col("_missed") > 0, missed).otherwise(ratio(F.col("_first") + F.col("_second"), F.lit(2)))
    return picked.select(*dims, median.alias(name))
