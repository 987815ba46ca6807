from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.streaming import ready as R

SCHEMA = "seq long, ts timestamp, value double"
START = dt.datetime(2024, 5, 2, 9, 0)


def _write(spark, folder, shard, first, seconds):
    rows = [(first + i, START + dt.timedelta(seconds=s), float(s)) for i, s in enumerate(seconds)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{shard}")


def _run(spark, tmp_path, at):
    stream = R.shard_streams(spark, {s: str(tmp_path / "in" / str(s)) for s in (0, 1, 2)}, SCHEMA)
    R.run_shards(stream, str(tmp_path / "out"), str(tmp_path / "offsets"), at, [0, 1, 2])


def test_a_late_shard_holds_the_marker_back(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ready = START + dt.timedelta(seconds=60)
    for s in (0, 1):  # two shards are far behind the instant, the third has only begun
        _write(spark, folder, s, 0, [1, 2, 300])
    _write(spark, folder, 2, 0, [1, 2])
    _run(spark, tmp_path, ready)
    _write(spark, folder, 0, 3, [301])
    _run(spark, tmp_path, ready)
    assert R.marker(spark, out) is None
    assert [r.problem for r in R.problems(spark, out, [0, 1, 2], ready).collect()] == ["NO_MARKER"]
    _write(spark, folder, 2, 2, [59, 63])
    _run(spark, tmp_path, ready)
    _write(spark, folder, 1, 3, [302])
    _run(spark, tmp_path, ready)
    rows = {r.shard: r for r in R.marker(spark, out).collect()}
    assert {s: r.next_seq for s, r in rows.items()} == {0: 4, 1: 3, 2: 4}
    assert all(r.watermark.replace(tzinfo=None) == START + dt.timedelta(seconds=61) for r in rows.values())
    assert R.problems(spark, out, [0, 1, 2], ready).count() == 0 and R.late_rows(spark, out, ready).count() == 0
    assert [(r.shard, r.problem) for r in R.problems(spark, out, [0, 1, 2, 7], ready).collect()] == [(7, "MISSING_SHARD")]
    assert {r.problem for r in R.problems(spark, out, [0, 1, 2], ready, 5.0).collect()} == {"EARLY_MARKER"}
    # a row of before the instant that comes after the marker is late, and the marker stays
    batch = rows[0].batch
    _write(spark, folder, 2, 4, [58, 64])
    _run(spark, tmp_path, ready)
    assert [r.seq for r in R.late_rows(spark, out, ready).collect()] == [4] and {r.batch for r in R.marker(spark, out).collect()} == {batch}
    first = R.first_ready(spark.read.parquet(out), spark.createDataFrame([(0,), (1,), (2,)], "shard int"), F.lit(ready)).collect()
    assert [r.batch for r in first] == [batch]


def test_gaps_speak_against_the_marker(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    ready = START + dt.timedelta(seconds=10)
    for s, first in ((0, 0), (1, 1), (2, 0)):
        _write(spark, folder, s, first, [1, 20])
    _run(spark, tmp_path, ready)
    for s in (0, 1, 2):
        _write(spark, folder, s, 5, [30])
    _run(spark, tmp_path, ready)
    assert [(r.shard, r.problem) for r in R.problems(spark, out, [0, 1, 2], ready).collect()] == [(1, "GAP")]


def test_first_ready_needs_all_shards(spark):
    t = lambda s: START + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([(0, 0, t(1)), (1, 0, t(90)), (2, 1, t(61)), (3, 1, t(70)), (5, 0, t(99))], "batch int, shard int, ts timestamp")
    shards = spark.createDataFrame([(0,), (1,)], "shard int")
    assert [(r.batch, r.watermark) for r in R.first_ready(rows, shards, F.lit(t(60))).collect()] == [(3, t(61))]
    assert R.first_ready(rows, shards, F.lit(t(80))).count() == 0 and R.first_ready(rows, spark.createDataFrame([(0,), (1,), (2,)], "shard int"), F.lit(t(60))).count() == 0
