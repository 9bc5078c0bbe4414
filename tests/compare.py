"""Order-insensitive comparison of a Spark result with its SQL counterpart."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return float(value) if type(value).__name__ == "Decimal" else value


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    ours = table(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    theirs = table([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} != {theirs[0]}"]
    found = [] if len(ours[1]) == len(theirs[1]) else [f"rows {len(ours[1])} != {len(theirs[1])}"]
    mine, other = {}, {}
    for row in ours[1]:
        mine[row] = mine.get(row, 0) + 1
    for row in theirs[1]:
        other[row] = other.get(row, 0) + 1
    left = [r for r in ours[1] if mine[r] != other.get(r, 0)]
    right = [r for r in theirs[1] if other[r] != mine.get(r, 0)]
    if left or right:
        found.append(f"{len(left)}/{len(right)} rows differ, such as {left[:limit]} against {right[:limit]}")
    return found
