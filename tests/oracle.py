"""Queries against their SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def connect(sf: str = SMALL):
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def compare(spark, con, name, query, sql, sf: str = SMALL):
    df = query(spark, sf)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    at = [cols.index(c) for c in sorted(cols)]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(cols), name
    assert got == want, (name, list((got - want).items())[:3], list((want - got).items())[:3])
