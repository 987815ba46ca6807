"""Work that must not be repeated or gathered: what a plan holds, beside the values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import fundamentals, newsrules, stats
from tidewater.plans import panel
from tidewater.sources import payloads


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_winsorised_gathers_no_group(spark):
    values = [float(v) for v in np.random.default_rng(2).integers(0, 300, 997) ** 2]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 2.0), ("c", None)], "g string, x double")
    w = stats.winsorised(df, ["g"], "x", 0.03, 0.9)
    low, high = np.percentile(values, [3, 90])
    assert sorted(r.x for r in w.where("g = 'a'").collect()) == pytest.approx(sorted([*np.clip(values, low, high), low]))
    assert [tuple(r) for r in w.where("g <> 'a'").orderBy("g").collect()] == [("b", 2.0), ("c", None)]
    assert " percentile(" not in _plan(w) and "[percentile(" not in _plan(w)


def test_vendor_ratio_parses_a_text_once(spark):
    df = spark.createDataFrame([('[{"name":"P/E","company":"8%","sector":"2"}]',), ("{",)], "p string")
    got = fundamentals.vendor_ratio(df, "p", "P/E")
    assert [(r.ratio.value, r.to_sector.value, r.ratio.reason) for r in got.collect()] == [(8.0, 4.0, None), (None, None, "MALFORMED_INPUT")]
    assert _plan(got).count("regexp_replace") <= 4


def test_names_are_split_once(spark):
    df = spark.createDataFrame([("Tata Motors (India) Ltd", "Tata Mot"), ("Tata Steel", "Tata Mot"), (None, "Tata Mot")], "a string, b string")
    got = df.select(newsrules.names_agree(F.col("a"), F.col("b"), strict=True).alias("ok"))
    assert [r.ok for r in got.collect()] == [True, False, False]
    assert _plan(got).count("regexp_replace") <= 4


def test_repeated_candles_are_compared_without_distinct_ones(spark):
    row = lambda at, close: f'["2024-01-01T03:4{at}:00Z",{close},{close},{close},{close},10,0]'
    body = '{"status":"success","data":{"candles":[' + ",".join([row(5, 1), row(5, 1), row(6, 1), row(6, 2), row(7, "null"), row(7, "null"), row(8, 3)]) + "]}}"
    df = spark.createDataFrame([("a", body)], "key string, body string").withColumns({"fetched_at": F.lit("2024-01-02").cast("timestamp"), "session_open": F.lit("2024-01-01 03:45:00").cast("timestamp")})
    got = payloads.candles(df)
    assert [r.reason for r in got.orderBy("start").collect()] == [None, "CONFLICTING_DUPLICATE", "MALFORMED_ROW", None]
    assert "distinct" not in _plan(got).lower()


def test_a_panel_is_shuffled_once(spark):
    got = panel.panel_signals(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and plan.count("Exchange") == 1
