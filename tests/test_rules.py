"""Cases that the tables of the queries do not hold: guards of linking, look-ahead, staleness, malformed payloads."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import canon, datasets, newsrules, snapshot, statements
from tidewater.operators import crosssection as X
from tidewater.sources import vendor


def _universe(spark):
    rows = [("KAL", "k1", "Kalpataru Ltd"), ("KPI", "k2", "Kalpataru Projects International Ltd"), ("TAM", "k3", "Tata Motors Ltd"), ("TAT", "k4", "Tata Motors Finance Ltd"), ("IND", "k5", "Indian Bank"), ("ACE", "k6", "Ace Ltd"), ("DUP", "k7", "Same Name Ltd"), ("DUQ", "k8", "Same Name Ltd")]
    return spark.createDataFrame(rows, "symbol string, instrument_key string, name string")


def test_headlines_name_the_longest_company_from_left_to_right(spark):
    titles = {1: "Kalpataru Projects International wins", 2: "Kalpataru shares rise", 3: "Kalpataru Projects shares rise", 4: "Tata Motors Finance and Tata Motors gain", 5: "Indian Bank and Ace fall", 6: "Same Name rises", 7: "", 8: "The Kalpataru"}
    items = spark.createDataFrame(list(titles.items()), "item_id int, title string")
    got: dict = {}
    for r in newsrules.headline_companies(items, newsrules.name_cores(_universe(spark))).collect():
        got.setdefault(r.item_id, []).append((r.at, r.instrument_key))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {1: ["k2"], 2: ["k1"], 4: ["k4", "k3"], 8: ["k1"]}


def test_filers_resolve_by_symbol_name_and_alias(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "Kalpataru Projects International Limited", "KPI", at(1)), (2, "Tata Motors Limited", None, at(2)), (3, "Same Name Ltd", None, at(3)), (4, "Tata Motors Mutual Fund", None, at(4)), (5, "Something Else", "KPI", at(5)), (6, "Kalpataru Projects Intl Limited", "KPI", at(6)), (7, "Kalpataru Projects Intl Limited", None, at(7))]
    got = {r.filing_id: (r.instrument_key, r.method) for r in newsrules.resolve_filers(spark.createDataFrame(rows, "filing_id int, filer string, symbol string, at timestamp"), _universe(spark)).collect()}
    assert got[1] == ("k2", "EXACT_SYMBOL") and got[2] == ("k3", "COMPANY_NAME") and got[3] == (None, "UNRESOLVED") and got[4] == (None, "UNRESOLVED") and got[5] == (None, "UNRESOLVED")


def test_controls_are_never_drawn_twice(spark):
    rows = [(s, k, k % 2, k < 6, k % 7 == 0) for s in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "i int, key int, cell int, picked boolean, banned boolean")
    got = X.matched_controls(df, ["i"], ["cell"], 5, "banned").collect()
    assert len(got) == 18 and len({(r.i, r.control) for r in got}) == 18
    assert all(r.control >= 6 and r.control % 7 and r.control % 2 == r.key % 2 for r in got)
    few = X.matched_controls(df.where("key < 8"), ["i"], ["cell"], 5).collect()
    assert sum(r.control is None for r in few) == 12


def test_a_snapshot_refuses_stale_bars_and_look_ahead(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(k, day(n), 10.0, 11.0, 9.0, 10.0 + n % 3, 100.0, day(n + 1)) for k in "ab" for n in range(30 if k == "a" else 25)]
    bars = spark.createDataFrame(rows, "key string, bucket timestamp, open double, high double, low double, close double, volume double, knowable_at timestamp")
    at = F.lit(day(30)).cast("timestamp")
    got = {(r.key, r.feature_id): (r.value, r.reason) for r in snapshot.snapshot([snapshot.bar_rows(bars, bars.where("key = 'a'"), at, F.lit(day(28)))], at).collect()}
    assert got["a", "ret_1d"][0] is not None and got["a", "ret_5d"][1] is None  # the bar of day 29 is knowable at the instant, not before
    assert all(v == (None, "MISSING_INPUT") for (k, _), v in got.items() if k == "b")
    late = spark.createDataFrame([("INSTRUMENT", "a", "x", 1.0, None, day(30), "h")], "scope string, key string, feature_id string, value double, reason string, input_max_knowable_at timestamp, inputs_sha256 string")
    with pytest.raises(Exception, match="look-ahead: a x"):
        snapshot.snapshot([late], at).collect()
    registered = spark.createDataFrame([("x", "CONTEXT")], "feature_id string, scope string")
    assert [r.feature_id for r in snapshot.conflicts(registered, late).collect()] == ["x"]


def test_statements_that_cannot_be_read(spark):
    rows = [(None,), ("[]",), ('{"full_statement": []}',), ('{"full_statement": [{"particular": "Revenue", "history": [{"period": "Mar 2024", "value": "-5"}, {"period": "Mar 2025", "value": "1,005.5"}]}]}',), ('{"full_statement": [{"particular": "Revenue", "history": [{"period": "?", "value": "5"}]}]}',)]
    df = spark.createDataFrame(rows, "p string").withColumn("l", statements.statement_line(F.col("p"), "Revenue"))
    assert [r.g.reason for r in df.select(statements.growth(F.col("l"), F.col("p")).alias("g")).collect()] == ["MISSING_INPUT", "MALFORMED_INPUT", "MISSING_INPUT", "DIVISION_UNDEFINED", "MISSING_INPUT"]


def test_month_plan_skips_months_without_a_successor(spark):
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2024, 3, 4)]
    got = X.month_plan(spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day date, i int")).collect()
    assert [(r.formation, r.entry, r.exit) for r in got] == [(1, 2, 4)]


def test_filters_are_named_or_refused(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "k int, tags array<string>")
    assert [r.k for r in canon.where_any(df, ("k", "tags"), tags="b", k=None).collect()] == [1]
    with pytest.raises(ValueError):
        canon.where_any(df, ("k",), other=1)


def test_samples_without_labels_or_features(spark):
    core = spark.createDataFrame([("d", "a", "f1", "VALID"), ("d", "b", "f1", "STALE"), ("d", "c", "f1", "VALID")], "session string, key string, feature_id string, status string")
    lab = spark.createDataFrame([("d", "a", "l1", 1.0, "VALID", None, ["EXTREME_UNEXPLAINED"]), ("d", "b", "l1", None, "INVALID", "X", [])], "session string, key string, label_id string, value double, status string, reason string, flags array<string>")
    got = {r.key: r for r in datasets.samples(core, lab, core.where("key = 'a'").select("session", "key"), 1).collect()}
    assert got["a"].eligible and got["a"].masks == ["CA_WINDOW", "EXTREME_UNEXPLAINED"]
    assert got["b"].exclusions == ["CORE_FEATURE_NOT_VALID", "LABEL_X"] and got["c"].exclusions == ["NO_LABEL"]
    bad = lab.unionByName(lab.where("key = 'a'").withColumn("flags", F.array().cast("array<string>")))
    gates = {r.gate: r.violations for r in datasets.label_integrity(bad).collect()}
    assert gates == {"value_or_reason": 0, "flags_differ": 1, "label_twice": 1, "status_without_value": 0, "not_finite": 0}


def test_event_calendar_and_bad_payloads(spark, tmp_path):
    (tmp_path / "e.csv").write_text("date,event\n2024-01-05, Budget \nsoon,x\n")
    got = [tuple(r) for r in vendor.event_calendar(spark, str(tmp_path / "e.csv")).collect()]
    assert got == [(dt.date(2024, 1, 5), "Budget", None), (None, "x", "BAD_DATE")]
    h = vendor.holidays(spark.createDataFrame([("{",), ('{"status":"success","data":[{"date":"2024-01-26","holiday_type":"ODD"}]}',)], "body string")).collect()
    assert sorted(str(r.reason) for r in h) == ["MALFORMED_PAYLOAD", "UNKNOWN_KIND"]
