"""Every registered query against its SQL in DuckDB over the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: v for k, v in entry.library_queries().items()}
SQL = entry.library_oracles()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v)


def compare(got, want):
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    cols = sorted(got.columns)
    at = [[d[0] for d in want.description].index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert len(a) == len(b), (len(a), len(b), a[:2], b[:2])
    for x, y in zip(a, b):
        assert x == y or all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf, duck, name):
    got = OWN[name](spark, sf)
    if name in SQL:
        compare(got, duck.execute(SQL[name]))
    else:
        got.collect()
