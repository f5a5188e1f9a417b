"""Many-to-one joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with fewer rows than this is no burden for one task.
HOT_ROWS = 2_000_000
# So many keys are spread at most; the unique-key side repeats their rows SALTS times.
HOT_LIMIT = 1000
SALTS = 128
# This many tracked items find every key with a 4096th of all rows; more would only
# make the sketches heavier, of which every scan task produces one.
SKETCH_ITEMS = 4096
SKETCH_GROUPS = 512
_SALT = "_salt"


def hot_keys(df: DataFrame, column: str, min_rows: int = HOT_ROWS) -> list:
    """Keys that hold at least ``min_rows`` rows, whatever their share.

    A table too short to hold such a key is only counted. Otherwise it takes
    one scan of one column into frequent-items sketches of fixed size, merged
    in two levels so that no task receives one from every scan task; the keys
    themselves are not shuffled. The answer only steers how a join is
    executed, never what it returns, so the sketch error is harmless. At most
    ``HOT_LIMIT`` keys come back to the driver; None stands for NULL.
    """
    if df.count() < min_rows:
        return []
    parts = (
        df.select(F.col(column).alias("key"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part"))
        .groupBy("part")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("key").isNull()).alias("nulls"),
            F.expr(f"approx_top_k_accumulate(key, {SKETCH_ITEMS})").alias("sketch"),
        )
    )
    # Grouped by a constant: an empty table yields no row, where a key-less
    # aggregate would have to combine no sketches at all, which fails.
    row = parts.groupBy(F.lit(0).alias("_all")).agg(
        F.sum("n").alias("n"),
        F.sum("nulls").alias("nulls"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {SKETCH_ITEMS}), {HOT_LIMIT})").alias("top"),
    ).first()
    if row is None:
        return []
    heavy = [t["item"] for t in row["top"] if t["item"] is not None and t["count"] >= min_rows]
    return [*heavy, None] if row["nulls"] >= min_rows else heavy


def join_many_to_one(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "left",
    hot: Sequence = (),
) -> DataFrame:
    """Join ``many`` to ``one``, whose ``key`` is unique.

    Without hot keys this is a plain join and Spark picks the strategy. With
    hot keys it is one join as well: their rows draw one of SALTS numbers by a
    hash of the row, the matching rows of ``one`` (one per key, at most
    ``HOT_LIMIT`` keys) are repeated for each number, and key and number are
    joined on. NULL keys match nothing and are spread alike.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported many-to-one join: {how}")
    if len(hot) == 0:
        return many.join(one, key, how)
    if len(hot) > HOT_LIMIT + 1:
        raise ValueError(f"{len(hot)} hot keys exceed the bound of {HOT_LIMIT}")
    is_hot = F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(False))
    drawn = F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")
    salted = many.withColumn(_SALT, F.when(F.col(key).isNull() | is_hot, drawn).otherwise(0))
    everywhere = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = one.withColumn(_SALT, F.explode(everywhere))
    return salted.join(repeated, [key, _SALT], how).drop(_SALT)


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """``df``, with the promise that ``key`` is unique checked where it is used.

    Lazy and without a job of its own: the table is collapsed to the key with
    a count, and a key that occurs twice fails the query that reads it. NULL keys match nothing
    in a join and may repeat.
    """
    others = [c for c in df.columns if c != key]
    repeated = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string"))).cast("boolean")
    held = F.when((F.col("_n") > 1) & F.col(key).isNotNull(), repeated).otherwise(F.lit(True))
    kept = [F.first(c).alias(c) for c in others]
    return df.groupBy(key).agg(F.count("*").alias("_n"), *kept).where(held).select(*df.columns)


def with_dims(fact: DataFrame, dims: dict[str, DataFrame], hot: dict[str, Sequence] | None = None) -> DataFrame:
    """Attach dimensions to a fact, each by its unique key, filters one way.

    Columns that the fact already has are kept from the fact. A dimension
    whose key repeats would multiply the fact's rows; it fails the query instead.
    """
    hot = hot or {}

    def attach(acc: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        key, dim = item
        extra = [c for c in dim.columns if c == key or c not in acc.columns]
        return join_many_to_one(acc, one_row_per_key(dim.select(*extra), key), key, "left", hot.get(key, ()))

    return reduce(attach, dims.items(), fact)
