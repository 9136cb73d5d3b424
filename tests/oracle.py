"""Rows of a Spark query against rows of DuckDB SQL, order aside."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def same(df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    assert got == want
