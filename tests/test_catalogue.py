"""Every query with an SQL oracle gives the oracle's rows; the others give rows of a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame):
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        if isinstance(x, bool) or str(type(x)).endswith("bool'>"):
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return round(float(x), 5) + 0.0
        return str(x)

    return sorted(([plain(v) for v in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) and len(got.columns)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(close(i, j) for i, j in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
