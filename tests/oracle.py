"""Compare a Spark result with the DuckDB result of its oracle SQL."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs first."""
    arrow = con.sql(sql).to_arrow_table()
    spark_arrow = spark_df.toArrow()
    if sorted(arrow.column_names) != sorted(spark_arrow.column_names):
        return f"columns {sorted(spark_arrow.column_names)} vs {sorted(arrow.column_names)}"
    types = {}
    for name in arrow.column_names:
        a, b = spark_arrow.schema.field(name).type, arrow.schema.field(name).type
        if str(a).replace("large_", "") != str(b).replace("large_", "") and not (
            str(a).startswith("timestamp") and str(b).startswith("timestamp")
        ):
            types[name] = (str(a), str(b))
    if types:
        return f"types {types}"
    if arrow.num_rows != spark_arrow.num_rows:
        return f"rows {spark_arrow.num_rows} vs {arrow.num_rows}"

    def rows(table) -> list[tuple]:
        cols = [table.column(n).to_pylist() for n in sorted(table.column_names)]
        return sorted(zip(*cols), key=repr)

    for left, right in zip(rows(spark_arrow), rows(arrow)):
        if repr(left) != repr(right):
            pairs = [
                (n, a, b)
                for n, a, b in zip(sorted(arrow.column_names), left, right)
                if repr(a) != repr(b)
            ]
            return f"values {pairs[:5]} in {left[:6]}"
    return None
