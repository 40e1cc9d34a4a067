"""Compares a query with its SQL the way the driver does: row count, columns, values without order."""

from __future__ import annotations

import datetime as dt
import glob
import os
from collections import Counter

import duckdb

DATA = os.environ.get("CAIRN_TESTDATA", "/root/testdata/sf0.01")


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int,)):
        return v
    if isinstance(v, float):
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if hasattr(v, "as_integer_ratio"):
        return plain(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if not isinstance(v, (str, bytes)) else v


def compare(spark, con, query, sql: str, folder: str = DATA) -> list[str]:
    df = query(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return [f"columns {names} and {sorted(columns)}"]
    at = [columns.index(c) for c in names]
    want = Counter(tuple(plain(r[k]) for k in at) for r in cur.fetchall())
    if got == want:
        return [] if want else ["no rows on either side"]
    return [f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}; columns {names}"]
