"""Compare a Spark result with a DuckDB result as bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf_dir) / table}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    ours = [tuple(r) for r in spark_df.collect()]
    found = []
    if sorted(columns) != sorted(spark_df.columns):
        found.append(f"columns {sorted(spark_df.columns)} != {sorted(columns)}")
        return found
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    a, b = bag(spark_df.columns, ours), bag(columns, theirs)
    found += [f"only spark {x}" for x in list((a - b))[:3]]
    found += [f"only duckdb {x}" for x in list((b - a))[:3]]
    return found
