"""Compares a DataFrame with an oracle's rows, order aside."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def same(df, names, rows):
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in sorted(names)]
    mine = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[k]) for k in at)) for r in rows)
    assert mine == theirs
