"""Compares a query's rows with those of its SQL."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(df, con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == want
