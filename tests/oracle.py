"""Comparison of a Spark result with DuckDB's answer to the equivalent SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from tablecare.plans.relations import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """Value in a form both engines share."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((v is None, str(type(v) if not isinstance(v, (int, float)) else 0), v if v is not None else 0) for v in r)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only here {list(set(got) - set(want))[:3]}; missing {list(set(want) - set(got))[:3]}"
    for g, w in zip(got, want):
        if g != w:
            return f"columns {sorted(names)}: {g} != {w}"
    return None
