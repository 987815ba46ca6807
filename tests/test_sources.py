from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewater.sources import frames, payloads, sinks
from tidewater.streaming import tail

T = dt.datetime


def _candle_payload(spark, rows, status="success"):
    body = json.dumps({"status": status, "data": {"candles": rows}}) if rows is not None else "{nothing"
    return spark.createDataFrame([("k", T(2024, 1, 2), T(2024, 1, 1, 9), body)], "key string, fetched_at timestamp, session_open timestamp, body string")


def test_candles_are_kept_or_named(spark):
    good = ["2024-01-01T09:00:00Z", 1, 2, 0.5, 1.5, 10, 0]
    rows = [good, good, ["2024-01-01T09:01:00Z", 1, 2, 0.5, 1.5, 10, 0], ["2024-01-01T09:01:00Z", 1, 2, 0.5, 1.6, 10, 0], ["2024-01-01T09:02:00Z", 1, 0.4, 0.5, 1.5, 10, 0], ["2024-01-01T09:03:00Z", 0, 2, 0, 1.5, 10, 0], ["2024-01-01T09:04:30Z", 1, 2, 0.5, 1.5, 10, 0], ["2024-02-01T09:05:00Z", 1, 2, 0.5, 1.5, 10, 0], ["x", 1], ["2024-01-01T09:06:00Z", "x", 2, 0.5, 1.5, 10, 0]]
    got = {(str(r.start)[11:19] if r.start else None): r.reason for r in payloads.candles(_candle_payload(spark, rows)).collect()}
    assert got == {"09:00:00": None, "09:01:00": "CONFLICTING_DUPLICATE", "09:02:00": "OHLC_INCONSISTENT", "09:03:00": "NON_POSITIVE_PRICE", "09:04:30": "OFF_GRID", "09:05:00": "AFTER_FETCH", None: "MALFORMED_ROW", "09:06:00": "MALFORMED_ROW"}
    assert [r.reason for r in payloads.candles(_candle_payload(spark, None)).collect()] == ["MALFORMED_PAYLOAD"]


def test_instruments(spark):
    rows = [{"instrument_key": "NSE_EQ|A", "segment": "NSE_EQ", "name": "A", "isin": "X", "lot_size": 1}, {"instrument_key": "NSE_EQ|A", "segment": "NSE_EQ", "name": "A2", "isin": "X", "lot_size": 1}, {"instrument_key": "BSE|B", "segment": "NSE_EQ"}, {"instrument_key": "bad", "segment": "x"}]
    got = {r.instrument_key: (r.name, r.reason) for r in payloads.instruments(spark.createDataFrame([(json.dumps(rows),)], "body string")).collect()}
    assert got == {"NSE_EQ|A": ("A", "CONFLICTING_DUPLICATE"), "BSE|B": (None, "SEGMENT_MISMATCH"), "bad": (None, "MALFORMED_KEY")}


def test_actions_and_flows(spark):
    body = json.dumps([{"type": "bonus", "details": [{"name": "Ex Date", "value": "3 Jan 2024"}, {"name": "Ratio", "value": "1:2"}]}, {"type": "dividend", "details": [{"name": "Amount", "value": "1,200.5"}]}])
    a, b = payloads.corporate_actions(spark.createDataFrame([("k", T(2024, 1, 1), body)], "key string, fetched_at timestamp, body string")).orderBy("action_type").collect()
    assert (a.action_type, a.ex_date, a.ratio_new, a.ratio_old) == ("BONUS", dt.date(2024, 1, 3), 1, 2) and (b.amount, b.ex_date) == (1200.5, None)
    body = json.dumps([{"day": "2024-01-01", "segment": "NSE_EQ", "buy_amt": "5.5", "sell_amt": "x"}])
    got = {r.series_code: r.value for r in payloads.flows(spark.createDataFrame([("FII", "1D", body)], "side string, interval string, body string")).collect()}
    assert got == {"FII|NSE_EQ|CASH|1D|buy_amt": 5.5, "FII|NSE_EQ|CASH|1D|sell_amt": None}


def test_feeds_and_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>http://x</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0530</pubDate></item><item><title>C</title><pubDate>soon</pubDate></item></channel></rss>")
    got = {r.title: (r.published_at, r.reason) for r in payloads.news_feed(spark, str(tmp_path / "feed.xml")).collect()}
    assert got == {"A & B": (T(2024, 1, 1, 4, 30), None), "C": (None, "BAD_TIMESTAMP")}
    (tmp_path / "r.csv").write_text("Ticker,Company Name,Result Date\nABC ,Abc Ltd,05-Jan-2024\nX,Y,later\n")
    got = [tuple(r) for r in payloads.results_csv(spark, str(tmp_path / "r.csv")).orderBy("symbol").collect()]
    assert got == [("ABC", "Abc Ltd", dt.date(2024, 1, 5), None), ("X", "Y", None, "BAD_DATE")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        payloads.results_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "bhav.csv").write_text("SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,TOTTRDQTY\nABC,EQ,1,2,0.5,1.5,10\nABC,BE,1,2,0.5,1.5,10\n")
    assert [r.key for r in payloads.bhavcopy(spark, str(tmp_path / "bhav.csv"), "2024-01-01").collect()] == ["NSE_EQ|ABC"]


def test_frame_archive(spark, tmp_path):
    whole, cut = tmp_path / "a.bin", tmp_path / "b.bin"
    frames.write_frames(str(whole), [(i, i * 10, bytes([i]) * i) for i in range(5)])
    import gzip

    raw = gzip.decompress(whole.read_bytes())
    cut.write_bytes(gzip.compress(raw[:-2]))
    (tmp_path / "c.bin").write_bytes(gzip.compress(raw[:-1] + b"\x00"))
    got = frames.read_frames(spark, f"{tmp_path}/*.bin").collect()
    by = {}
    for r in got:
        by.setdefault(r.shard[-5], []).append(r.fault)
    assert by == {"a": [None] * 5, "b": [None] * 4 + ["TRUNCATED"], "c": [None] * 4 + ["DIGEST_MISMATCH"]}
    assert sorted((r.seq, bytes(r.data)) for r in got if r.shard.endswith("a.bin")) == [(i, bytes([i]) * i) for i in range(5)]


def test_append_refuses_other_values(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    assert sinks.append(rows((1, 1.0), (2, None)), path, ["k"], ["v"]) == 2
    assert sinks.append(rows((1, 1.0), (2, None), (3, 3.0)), path, ["k"], ["v"]) == 1
    with pytest.raises(sinks.Conflict):
        sinks.append(rows((2, 5.0)), path, ["k"], ["v"])
    assert spark.read.parquet(path).count() == 3


def test_checkpoints_move_over_contiguous_windows_only(spark):
    c = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("b", dt.date(2024, 1, 1))], "stream string, through date")
    w = spark.createDataFrame([("a", dt.date(2024, 1, 2), dt.date(2024, 1, 5)), ("a", dt.date(2024, 1, 6), dt.date(2024, 1, 7)), ("a", dt.date(2024, 1, 9), dt.date(2024, 1, 10))], "stream string, start date, end date")
    assert {r.stream: r.through for r in sinks.advance(c, w).collect()} == {"a": dt.date(2024, 1, 7), "b": dt.date(2024, 1, 1)}


def _ticks(spark, rows):
    return spark.createDataFrame(rows, tail.TICKS)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(i, T(2024, 1, 1, 0, i), 1, "view", float(i), "{}") for i in range(30)]
    _ticks(spark, first).write.parquet(source)
    tail.run_to(tail.tail(spark, source), out, str(tmp_path / "c"))
    _ticks(spark, [(99, T(2024, 1, 2), 1, "view", 1.0, "{}")]).write.mode("append").parquet(source)
    tail.run_to(tail.tail(spark, source), out, str(tmp_path / "c"))
    assert spark.read.parquet(out).count() == 31


def test_late_rows_are_stored_and_counted(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _ticks(spark, [(1, T(2024, 1, 1), 1, "v", 1.0, "{}")]).coalesce(1).write.parquet(source)
    tail.append_batches(tail.tail(spark, source), out, str(tmp_path / "c"), "2024-01-01 12:00:00")
    # the batch that first passes the instant has no late rows; those after it have
    for rows in ([(2, T(2024, 1, 1, 1)), (3, T(2024, 1, 2))], [(4, T(2024, 1, 1, 2)), (5, T(2024, 1, 3))]):
        _ticks(spark, [(i, at, 1, "v", 1.0, "{}") for i, at in rows]).coalesce(1).write.mode("append").parquet(source)
        tail.append_batches(tail.tail(spark, source), out, str(tmp_path / "c"), "2024-01-01 12:00:00")
    assert {r.event_id: r.late for r in spark.read.parquet(out).collect()} == {1: False, 2: False, 3: False, 4: True, 5: False}
    assert tail.ready_batch(spark, out) == 1 and {r.batch: r.late for r in tail.late_counts(spark, out).collect()} == {0: 0, 1: 0, 2: 1}


def test_repeats_and_conflicts_are_told_apart(spark):
    schema = "k int, v double, at int"
    stored = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 0)], schema)
    batch = spark.createDataFrame([(1, 1.0, 5), (2, 9.0, 5), (3, 3.0, 5), (3, 3.0, 6), (4, 4.0, 5), (4, 5.0, 6)], schema)
    new, conflicts = tail.split_repeats(batch, stored, ["k"], ["v"], "at")
    assert sorted(map(tuple, new.collect())) == [(3, 3.0, 5), (4, 4.0, 5)] and sorted(map(tuple, conflicts.collect())) == [(2, 9.0, 5), (4, 5.0, 6)]
    states = {r.k: r.state for r in tail.poll_split(batch.where("at = 5"), stored, "k", "v").collect()}
    assert states == {1: "SEEN", 2: "CHANGED", 3: "NEW", 4: "NEW"}


def test_repeats_within_the_watermark_go(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, T(2024, 1, 1), 1, "v", 1.0, "{}"), (1, T(2024, 1, 1), 1, "v", 1.0, "{}"), (2, T(2024, 1, 1), 1, "v", 1.0, "{}")]
    _ticks(spark, rows).write.parquet(source)
    tail.run_to(tail.deduplicated(tail.tail(spark, source), ["event_id"], "ts"), out, str(tmp_path / "c"))
    assert spark.read.parquet(out).count() == 2


def test_tracked_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(p, 10.0, 12.0, 15.0, 20.0, 8.0, T(2024, 1, 1, 0, i), x) for p, path in ((1, [9, 11, 16, 21, 5]), (2, [11, 7, 30]), (3, [30, 31])) for i, x in enumerate(map(float, path))]
    schema = "plan_id long, entry_low double, entry_high double, t1 double, t2 double, stop double, ts timestamp, price double"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(source)
    want = sorted((r.plan_id, r.kind, r.price) for r in tail.track_batch(df).collect())
    assert want == [(1, "ENTRY", 11.0), (1, "T1", 16.0), (1, "T2", 21.0), (2, "ENTRY", 11.0), (2, "STOP", 7.0)]
    stream = spark.readStream.schema(schema).parquet(source)
    tail.run_to(tail.track(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted((r.plan_id, r.kind, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_page_text(spark):
    html = "<html><head><title>T</title></head><body><script>x</script><p>A &amp;&lt; <b>B</b></p><!-- c --></body></html>"
    assert spark.range(1).select(payloads.article_text(F.lit(html)).alias("t")).first().t == "A &< B"
    assert payloads.drift(spark.createDataFrame([('{"a":1,"b":2}',), ("{}",)], "body string"), "body", {"a"}).collect()[0].field == "b"
