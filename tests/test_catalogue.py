"""Every registered query of the library against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from siftpool.plans import catalogue

SMALL = os.environ.get("SIFTPOOL_SF", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: (0.0 if x == 0 else round(x, 9) if math.isfinite(x) else str(x)) if isinstance(x, float) else x
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name == "resume_equals_uninterrupted":
        assert all(r[3] for r in rows)
    if name in SQL:
        expected = duck.sql(SQL[name])
        assert sorted(expected.columns) == sorted(df.columns)
        a, b = bag(rows, df.columns), bag(expected.fetchall(), expected.columns)
        assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
