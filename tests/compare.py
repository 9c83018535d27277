"""Running a registered query and its SQL on the same tables."""

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(value)
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in ordered.astype(object).itertuples(index=False))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty when both hold the same rows under the same names."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    ours, theirs = rows(spark_frame), rows(sql_frame)
    if ours == theirs:
        return ""
    only_ours = sorted(set(ours) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(ours))[:3]
    return f"{len(ours)} / {len(theirs)} rows; only Spark {only_ours}; only SQL {only_theirs}"
