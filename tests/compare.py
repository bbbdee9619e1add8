"""Rows of a query against those of its SQL, without order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


def rows(columns, found):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


def sql(text, sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    out = con.execute(text)
    names = [d[0] for d in out.description]
    return names, [dict(zip(names, r, strict=True)) for r in out.fetchall()]


def same(df, text, sf):
    names, want = sql(text, sf)
    assert sorted(names) == sorted(df.columns)
    assert rows(sorted(names), [r.asDict() for r in df.collect()]) == rows(sorted(names), want)
