"""Running a query in Spark and its SQL in DuckDB over the same tables."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def differences(spark_rows, spark_columns, oracle):
    """What differs between collected Spark rows and a DuckDB result, empty if nothing."""
    names = [c[0] for c in oracle.description]
    if sorted(names) != sorted(spark_columns):
        return f"columns {sorted(spark_columns)} and {sorted(names)}"
    order = [names.index(c) for c in spark_columns]
    expected = Counter(tuple(row[i] for i in order) for row in oracle.fetchall())
    found = Counter(tuple(row) for row in spark_rows)
    if expected == found:
        return ""
    extra, lost = found - expected, expected - found
    return (
        f"{sum(found.values())} and {sum(expected.values())} rows; "
        f"only Spark {list(extra.items())[:3]}; only DuckDB {list(lost.items())[:3]}"
    )
