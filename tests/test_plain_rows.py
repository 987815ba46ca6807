"""Queries against their SQL over bars with a low of zero and with quotients halfway between two roundings."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.test_queries import DATA, _sorted
from tidewater.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Hourly events of two keys over 40 days: prices from 0 upwards, 64 and 123.1 among them (their quotient is 0.9234375 and one)."""
    at = tmp_path_factory.mktemp("odd")
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for k, key in enumerate(("click", "view")):
        for i in range(960):
            rows.append((len(rows), t0 + dt.timedelta(hours=i), key, k, 64.0 if i % 20 == 0 and i % 40 == 0 else 123.1 if i % 40 == 20 else float((i * 37 + k) % 90) if i % 24 else 0.0))
    names = ("event_id", "ts", "event_type", "user_id", "value")
    types = (pa.int64(), pa.timestamp("us"), pa.string(), pa.int64(), pa.float64())
    pq.write_table(pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(zip(names, types))}), f"{at}/events.parquet")
    os.symlink(f"{DATA}/nation.parquet", f"{at}/nation.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["label_flags", "labels_session", "ret_sma_range"])
def test_zero_lows_and_halves(spark, odd, name):
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, odd)
    got = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(got.fetchall(), columns)
