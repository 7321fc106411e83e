"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tracemill.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(_plain(r[i])) for i in order) for r in rows)


def test_flagship():
    assert FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLE_SQL[name])
    want = _rows([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
