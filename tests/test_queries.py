"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

from tidewater.plans import catalog

DATA = os.environ.get("TIDEWATER_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _sorted(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        got = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert _sorted(rows, df.columns) == _sorted(got.fetchall(), columns)
    assert df.columns


def test_sql_only_for_registered_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
