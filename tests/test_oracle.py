"""Every registered query against its SQL statement, row by row."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (bool, int, float)) else str(v)


def sort_key(row):
    return tuple((v is None, isinstance(v, str), round(v, 3) if isinstance(v, float) else v) if v is not None else (True, False, 0)
                 for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=sort_key)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=sort_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for c, x, y in zip(columns, a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6), (c, a, b)
            else:
                assert x == y, (c, a, b)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_net_profit" in df.columns
