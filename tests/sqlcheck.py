"""Rows of a query against its SQL twin over the test tables."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("EPISTRATA_TEST_DATA", "/root/testdata/sf0.01")


def connect():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return float(v) if isinstance(v, (int, float)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    out = [tuple(_cell(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 + 1e-9 * abs(q)), (x, y)
