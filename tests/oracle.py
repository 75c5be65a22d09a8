"""Compares a query with its SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in got), key=repr)


def same(spark, fn, sql, sf=SF):
    df = fn(spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (x, y)
