"""Comparing a Spark result with DuckDB's."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs
