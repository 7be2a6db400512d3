"""Compare a Spark result with its DuckDB oracle, independent of row and column order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat(" ") if isinstance(v, datetime.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return type(v).__name__


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str | None:
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    so = sorted(range(len(spark_cols)), key=lambda i: spark_cols[i])
    do = sorted(range(len(duck_cols)), key=lambda i: duck_cols[i])
    a = Counter(tuple(norm(r[i]) for i in so) for r in spark_rows)
    b = Counter(tuple(norm(r[i]) for i in do) for r in duck_rows)
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}: {list((a - b))[:2]} / {list((b - a))[:2]}"
    if a != b:
        return f"values differ ({sum((a - b).values())}): {list((a - b))[:3]} / {list((b - a))[:3]}"
    for i, j in zip(so, do):
        x = {kind(norm(r[i])) for r in spark_rows if r[i] is not None}
        y = {kind(norm(r[j])) for r in duck_rows if r[j] is not None}
        if x != y:
            return f"types differ on {spark_cols[i]}: {x} vs {y}"
    return None
