"""Run a registered query in Spark and its SQL in DuckDB and compare names, types and values."""

from __future__ import annotations

import datetime
import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, build, sql):
    """An empty list when both sides agree, otherwise what differs."""
    t0 = time.time()
    df = build(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {df.columns} vs {names}")
        return problems, len(got), t1 - t0, t2 - t1
    spark_types = {n: _TYPES[t] for n, t in df.dtypes}
    for n, t in zip(names, types):
        if spark_types[n] != t:
            problems.append(f"type of {n}: {spark_types[n]} vs {t}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a, only_b = list((a - b).elements()), list((b - a).elements())
        problems.append(f"{sorted(names)}: spark {len(got)} rows, sql {len(want)} rows; only spark {len(only_a)}: "
                        f"{[str(x)[:400] for x in only_a[:2]]}; only sql {len(only_b)}: {[str(x)[:400] for x in only_b[:2]]}")
    return problems, len(got), t1 - t0, t2 - t1
