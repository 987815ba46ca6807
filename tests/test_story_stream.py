from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import stories as S
from tidewater.streaming import stories as T

START = dt.datetime(2024, 3, 1)


def _items(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)]
    subjects = [rng.sample(vocabulary, rng.randrange(1, 9)) for _ in range(12)]
    rows, at = [], START
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 1, 5, 30, 200]), seconds=rng.randrange(60))
        words = [w for w in rng.choice(subjects) if rng.random() < 0.85] + rng.sample(vocabulary, rng.choice([0, 0, 1, 2]))
        companies = rng.sample(["A", "B", "C"], rng.choice([0, 0, 1, 2]))
        rows.append(
            (
                i, rng.choice([None, None, "", f"u{rng.randrange(n // 4)}"]), rng.choice([None, f"t{rng.randrange(n)}", f"t{rng.randrange(n // 3)}"]), rng.random() < 0.15, rng.choice([None] + [words] * 9),
                companies, rng.sample(["P:x", "P:y", "Q:z"], rng.choice([0, 1, 1, 2])), rng.choice(["OTHER", "RESULTS", "MACRO", None]), rng.choice([None, at, at, at - dt.timedelta(hours=rng.choice([1, 5, 11, 14]))]), at,
            )
        )
    return rows


def _fold(rows):
    """Every item against all earlier ones, one after the other."""
    members, out = [], {}
    for i, url, title, strict, words, companies, entities, category, at, known in sorted(rows, key=lambda r: (r[9], r[0])):
        micros = lambda t: int((t - START).total_seconds() * 1_000_000)
        m = {"item_id": i, "url": url or "", "title_hash": title, "strict": strict, "words": frozenset(words or ()), "companies": frozenset(companies), "entities": frozenset(entities), "category": category, "at": micros(at or known), "known": micros(known)}
        best = None
        for c in members:
            if abs(m["at"] - c["at"]) <= 6 * T.HOUR and m["known"] - c["at"] <= 12 * T.HOUR:
                said = T.judge(m, c)
                if said and (best is None or said[0] > best[0]):
                    best = (*said, c["item_id"])
        story = out[best[2]][0] if best else i
        out[i] = (story, best[1] if best else "FOUNDER", best[0] if best else 1.0, best[2] if best else None)
        members.append(m)
    return out


def _df(spark, rows):
    return spark.createDataFrame(rows, S.ITEM.replace("timestamp", "timestamp_ntz"))


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_against_a_fold(spark, seed):
    rows = _items(seed, 140)
    want = _fold(rows)
    got = {r.item_id: (r.story_id, r.method, r.score, r.with_id) for r in S.assign(_df(spark, rows).repartition(3)).collect()}
    assert got == want
    assert {v[1] for v in want.values()} == {"FOUNDER", "SAME_URL", "SAME_TITLE", "SIMILAR"} and len({v[0] for v in want.values()}) < 130
    assert S.assign(_df(spark, [])).count() == 0


def test_a_long_chain_has_one_story(spark):
    rows = [(i, None, f"t{i // 2}" if i % 2 == 0 else f"t{(i + 1) // 2}", True, [], [], [], "OTHER", None, START + dt.timedelta(minutes=i)) for i in range(60)]
    rows = [(i, f"u{i // 2}", f"t{(i + 1) // 2}", *r[3:]) for i, r in enumerate(rows)]  # each shares its address or its title with the one before
    assert {r.story_id for r in S.assign(_df(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("cuts", [(), (60,), (13, 14, 40, 77, 100)])
def test_stream_is_the_batch_however_it_is_cut(spark, tmp_path, cuts):
    rows = sorted(_items(5, 120), key=lambda r: (r[9], r[0]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for a, b in zip((0, *cuts), (*cuts, len(rows))):
            # each part is one file, and each run of the query goes on behind the last
            _df(spark, rows[a:b]).withColumns({c: F.col(c).cast("timestamp") for c in ("at", "knowable_at")}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            T.run(spark.readStream.schema(S.ITEM).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "offsets"))
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.item_id: (r.story_id, r.method, r.score, r.with_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == _fold(rows)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    found = spark.createDataFrame([(1, START, None, None, None, None), (2, START, 1, 5, 0.9, "SIMILAR"), (2, START, 1, 5, 1.0, "SAME_URL"), (3, START, 9, 5, 0.7, "SIMILAR")], T.FOUND)
    for _ in range(2):
        T.write_batch(found, 0, str(tmp_path / "s"))
    T.write_batch(spark.createDataFrame([(4, START, 2, 5, 0.8, "SIMILAR")], T.FOUND), 1, str(tmp_path / "s"))
    T.write_batch(spark.createDataFrame([(4, START, 2, 5, 0.8, "SIMILAR")], T.FOUND), 1, str(tmp_path / "s"))
    got = sorted((r.item_id, r.story_id, r.method) for r in spark.read.parquet(str(tmp_path / "s")).collect())
    assert got == [(1, 1, "FOUNDER"), (2, 1, "SAME_URL"), (3, 3, "SIMILAR"), (4, 1, "SIMILAR")]
