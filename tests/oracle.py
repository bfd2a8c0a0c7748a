"""Compare a query with its SQL in DuckDB, rows as multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if hasattr(v, "as_tuple"):
        return int(v) if v == int(v) else float(f"{float(v):.9g}")
    return v


def rows_of(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def oracle_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in cur.fetchall())


def same(df, con, sql: str) -> None:
    names, want = oracle_rows(con, sql)
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
