"""Comparison of a Spark query with its SQL in DuckDB, by multiset of rows."""

import os
from collections import Counter
from functools import cache

import duckdb


@cache
def connection(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 8) + 0.0
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def expected(folder, sql):
    r = connection(folder).execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(tuple(plain(row[i]) for i in at) for row in r.fetchall())


def same(df, folder, sql):
    got_cols, got = rows_of(df)
    want_cols, want = expected(folder, sql)
    assert got_cols == want_cols
    assert got == want, f"only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
