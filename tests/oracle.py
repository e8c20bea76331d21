"""Run registered queries beside their SQL on the same tables and compare rows."""

from __future__ import annotations

import math
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def sql_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}")
    if isinstance(value, Decimal):
        return float(value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, build, sql):
    """None when equal, else what differs; and the seconds the Spark side took."""
    started = time.time()
    df = build(spark, folder)
    got = df.collect()
    took = time.time() - started
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", took
    a = _bag(df.columns, [tuple(r) for r in got])
    b = _bag(names, want)
    if a == b:
        return None, took
    only = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {len(got)} vs {len(want)}; spark only {only[0]}; sql only {only[1]}", took
