"""Typed readers. Nothing here infers a schema."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import HOT_ROWS, hot_keys
from ..operators.populations import CANCELLED_STATUSES
from ..schemas import MULTILINE_TABLES, SCHEMAS, TRIMMED_COLUMNS

CORRUPT = "_corrupt_record"
REJECTED = "rejected"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
# A file that cannot be split should be no longer; at about 50 MB/s one task reads it in 20 seconds.
MULTILINE_FILE_BYTES = 1 << 30
MOST_NAMED = 20
WHOLE = (T.ShortType, T.IntegerType, T.LongType)


@dataclass
class RawTables:
    """The eight raw tables a mart is built from.

    ``line_delivered`` names a timestamp column of ``order_items`` for sources
    that record delivery per line; the order then counts as delivered at its
    latest delivered line, found in the same pass that collapses the items.
    """

    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    category_translation: DataFrame
    cancelled_statuses: tuple[str, ...] = CANCELLED_STATUSES
    line_delivered: str | None = None
    # Rows from which a key is looked for and spread; None looks for none.
    hot_rows: int | None = None
    known_hot: dict = field(default_factory=dict, repr=False)
    # Rejected records by table, of tables that were landed from files.
    rejected: dict = field(default_factory=dict, repr=False)

    def by_name(self) -> dict[str, DataFrame]:
        """The tables under their declared names."""
        renamed = {"product_category_translation": "category_translation"}
        return {name: getattr(self, renamed.get(name, name)) for name in SCHEMAS}

    def hot(self, table: str, column: str) -> list:
        """Keys too heavy for one task, found once per table and column; none unless ``hot_rows`` is set."""
        if self.hot_rows is None:
            return []
        if (table, column) not in self.known_hot:
            self.known_hot[table, column] = hot_keys(getattr(self, table), column, self.hot_rows)
        return self.known_hot[table, column]


def read_csv(
    spark: SparkSession,
    root: str,
    table: str,
    files: Mapping[str, str] | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """Read one raw CSV table with its declared types.

    A record that does not fit keeps its raw text in ``_corrupt_record`` and
    NULL in the cells that failed; see :func:`split_quarantine`. A header that
    names other columns is an error. ``files`` maps a table to its file name, folder
    or pattern where that is not ``<table>.csv``; every file has its header. Whole numbers may be written with a
    fraction of zeros (``40.0``), as spreadsheets do; any other fraction is
    rejected with its record.
    """
    declared = SCHEMAS[table]
    whole = [f for f in declared.fields if isinstance(f.dataType, WHOLE)]
    # Whole numbers are read as decimals first, which hold any of them exactly.
    fields = [T.StructField(f.name, T.DecimalType(20, 4)) if f in whole else f for f in declared.fields]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType(), True)])
    name = (files or {}).get(table, f"{table}.csv")
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", table in MULTILINE_TABLES)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(f"{root}/{name}")
    )
    fits = F.lit(True)
    for f in whole:
        fits = fits & F.coalesce(F.col(f.name) == F.col(f.name).try_cast(f.dataType), F.col(f.name).isNull())
    # All cells of a rejected record are kept as text; the reader has it only for what it rejected itself.
    as_text = F.concat_ws(",", *(F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in declared.fields))
    df = df.withColumns(
        {CORRUPT: F.when(fits, F.col(CORRUPT)).otherwise(F.coalesce(CORRUPT, as_text))}
        | {f.name: F.col(f.name).try_cast(f.dataType) for f in whole}
    )
    trimmed = () if keep_text else TRIMMED_COLUMNS.get(table, ())
    return df.drop(*trimmed)


def oversized_files(
    spark: SparkSession,
    root: str,
    table: str,
    files: Mapping[str, str] | None = None,
    bound: int = MULTILINE_FILE_BYTES,
) -> DataFrame:
    """(path, length) of the files of a table that one task has to read although they are longer than ``bound``.

    Records with line breaks keep a file from being split, so each of its files is
    one task's work, and a table in many files (a folder, or a pattern as its name) is read
    by as many tasks. Sizes come from the file listing; no content is read. Tables without line
    breaks have no such files.
    """
    name = (files or {}).get(table, f"{table}.csv")
    listed = spark.read.format("binaryFile").load(f"{root}/{name}").select("path", "length")
    return listed.where(F.lit(table in MULTILINE_TABLES) & (F.col("length") > bound))


def _warn_of_long_files(spark: SparkSession, root: str, table: str, files: Mapping[str, str] | None, bound: int) -> None:
    if table not in MULTILINE_TABLES:
        return
    for r in oversized_files(spark, root, table, files, bound).orderBy(F.desc("length")).limit(MOST_NAMED).collect():
        text = f"{r['path']} holds {r['length']} bytes, which one task has to read; deliver {table} in files of at most {bound}"
        warnings.warn(text, stacklevel=3)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows without the marker column, and the rejected ones with it."""
    bad = F.col(CORRUPT).isNotNull()
    return df.where(~bad).drop(CORRUPT), df.where(bad)


def land_parquet(
    spark: SparkSession,
    csv_root: str,
    out_root: str,
    files: Mapping[str, str] | None = None,
    multiline_bytes: int = MULTILINE_FILE_BYTES,
) -> None:
    """Ingest every CSV table once; later jobs read splittable, prunable Parquet.

    One pass per table: rejected records land beside the good ones, in a
    partition of their own that :func:`load_parquet` never opens. A table may be one
    file, a folder of files or a pattern, see ``files`` of :func:`read_csv`. A file with line
    breaks in its records that is longer than ``multiline_bytes`` is landed whole as any other,
    by one task, and warned of.
    """
    for table in SCHEMAS:
        _warn_of_long_files(spark, csv_root, table, files, multiline_bytes)
        df = read_csv(spark, csv_root, table, files)
        marked = df.withColumn(REJECTED, F.col(CORRUPT).isNotNull())
        marked.write.mode("overwrite").partitionBy(REJECTED).parquet(f"{out_root}/{table}")


def _landed(spark: SparkSession, root: str, table: str) -> DataFrame:
    trimmed = TRIMMED_COLUMNS.get(table, ())
    fields = [f for f in SCHEMAS[table].fields if f.name not in trimmed]
    extra = [T.StructField(CORRUPT, T.StringType()), T.StructField(REJECTED, T.BooleanType())]
    return spark.read.schema(T.StructType([*fields, *extra])).parquet(f"{root}/{table}")


def load_parquet(spark: SparkSession, root: str, hot_rows: int | None = HOT_ROWS) -> RawTables:
    """The landed tables, ready for the mart builders; keys from ``hot_rows`` rows on are looked for while building."""
    tables = {name: _landed(spark, root, name).where(~F.col(REJECTED)).drop(CORRUPT, REJECTED) for name in SCHEMAS}
    tables["category_translation"] = tables.pop("product_category_translation")
    return RawTables(**tables, hot_rows=hot_rows, rejected={name: quarantined(spark, root, name) for name in SCHEMAS})


def quarantined(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rejected records of a landed table with their raw text."""
    return _landed(spark, root, table).where(F.col(REJECTED)).drop(REJECTED)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """Scan a database table instead of a file, in parallel when a split column is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_column is not None:
        if bounds is None:
            raise ValueError("a split column needs its lower and upper bound")
        reader = (
            reader.option("partitionColumn", split_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    return reader.load()
