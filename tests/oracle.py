"""Compares a Spark result with DuckDB SQL over the same tables."""

import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def check(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in cur.fetchall())
    got = Counter(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
