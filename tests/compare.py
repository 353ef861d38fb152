"""Compare a registered query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float, bool)) or v is None
                                           else (False, "n", float(v)) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """Readable differences; empty when names, counts and values agree."""
    spark_names, spark_rows = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    sql_names, sql_rows = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(spark_names) != sorted(sql_names):
        return [f"columns {sorted(spark_names)} != {sorted(sql_names)}"]
    a, b = sorted_rows(spark_names, spark_rows), sorted_rows(sql_names, sql_rows)
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}"]
    wrong = [(p, q) for p, q in zip(a, b) if p != q]
    return [f"{len(wrong)} of {len(a)} rows differ over {sorted(spark_names)}: {wrong[0][0]} != {wrong[0][1]}"] if wrong else []
