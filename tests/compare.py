"""A Spark result against DuckDB SQL over the same tables."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def _value(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 9) if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f" else v


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = [sorted((tuple(_value(v) for v in r) for r in df[cols].itertuples(index=False)), key=str) for df in (a, b)]
    assert len(rows[0]) == len(rows[1])
    for x, y in zip(*rows):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9) for p, q in zip(x, y)), (x, y)
