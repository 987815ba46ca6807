from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidewater.operators import bars as B
from tidewater.operators import pit, snapshot
from tidewater.operators import replay as R

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def _bars(spark, keys, days, seed):
    rng = random.Random(seed)
    rows = []
    for k in keys:
        price = 100.0
        for d in range(days):
            if rng.random() < 0.1:
                continue
            price *= 1 + rng.uniform(-0.05, 0.05)
            bucket = START + d * DAY
            for version in range(rng.choice([1, 1, 1, 2, 3])):  # later versions revise the bar
                close = price * (1 + 0.01 * version)
                rows.append((k, bucket, price, max(price, close) * 1.01, min(price, close) * 0.99, close, 100 + d, bucket + (1 + version * 3) * DAY + dt.timedelta(hours=rng.randrange(40)), version))
    return spark.createDataFrame(rows, "key string, bucket timestamp_ntz, open double, high double, low double, close double, volume long, knowable_at timestamp_ntz, version int")


def _instants(spark, *days):
    rows = [(START + d * DAY + dt.timedelta(hours=9), START + (d - 2) * DAY) for d in days]
    return rows, spark.createDataFrame(rows, "as_of timestamp_ntz, previous_session timestamp_ntz")


def test_replay_is_one_snapshot_an_instant(spark):
    bars, index = _bars(spark, ["a", "b", "c", "d", "e"], 90, 1), _bars(spark, ["i"], 90, 2)
    sectors = spark.createDataFrame([(k, "x") for k in "abcd"], "key string, sector string")
    rows, instants = _instants(spark, 3, 30, 31, 85, 200)
    columns = ["scope", "key", "feature_id", "value", "reason", "input_max_knowable_at", "inputs_sha256"]
    got = R.replay_bars(bars, index, instants, sectors)
    replayed = sorted(map(tuple, got.select("as_of", *columns).collect()), key=str)
    single = []
    for as_of, previous in rows:
        at = F.lit(as_of).cast("timestamp_ntz")
        latest = lambda df, at=at: pit.latest_by(pit.as_of(df, at), ["key", "bucket"], ["knowable_at", "version"])
        one = snapshot.bar_rows(latest(bars), latest(index), at, F.lit(previous).cast("timestamp_ntz"), sectors)
        single += [(as_of, *r) for r in one.select(*columns).collect()]
    assert replayed == sorted(single, key=str) and len(replayed) > 300
    # the width of a slot changes no row
    wide = R.replay_bars(bars, index, instants, sectors, slot_seconds=30 * 86_400)
    assert sorted(map(tuple, wide.select("as_of", *columns).collect()), key=str) == replayed


def test_versions_at_their_borders(spark):
    t = lambda h: START + dt.timedelta(hours=h)
    facts = spark.createDataFrame([("k", 1, t(10)), ("k", 2, t(20)), ("k", 3, t(20)), ("l", 4, t(30))], "key string, no int, knowable_at timestamp_ntz")
    instants = spark.createDataFrame([(t(h),) for h in (9, 10, 11, 20, 21, 500)], "as_of timestamp_ntz")
    for slot in (3600, 86_400, 10_000_000):
        got = {(r.as_of, r.key): r.no for r in R.versions(facts, instants, ["key"], ["no"], slot).collect()}
        # strictly after it became knowable; of two at once the later one alone
        assert got == {(t(11), "k"): 1, (t(20), "k"): 1, (t(21), "k"): 3, (t(500), "k"): 3, (t(500), "l"): 4}
    none = instants.where("false")
    assert R.versions(facts, none, ["key"], ["no"]).count() == 0 and R.versions(facts.where("false"), instants, ["key"], ["no"]).count() == 0


def test_universe_and_append(spark):
    bars = _bars(spark, ["a", "b"], 40, 3)
    _, instants = _instants(spark, 20, 41, 100)
    rows = R.universe(bars, instants).collect()
    assert {r.as_of for r in rows} == {START + d * DAY + dt.timedelta(hours=9) for d in (20, 41)}
    assert all((r.last_bucket != r.as_of - dt.timedelta(hours=9) - 2 * DAY) == r.stale for r in rows)
    done = R.replay_bars(bars, bars.where("key = 'a'"), instants.where("as_of < '2024-02-01'"))
    whole = R.replay_bars(bars, bars.where("key = 'a'"), instants)
    absent, conflicts = R.to_append(done, whole)
    assert conflicts.count() == 0 and absent.count() == whole.count() - done.count() > 0
    assert R.undone(instants, done).count() == 2
    _, conflicts = R.to_append(done.withColumn("value", F.col("value") + 1), whole)
    assert conflicts.count() == done.where("value IS NOT NULL").count()


def test_as_if_live(spark):
    t = lambda d, h=0: START + d * DAY + dt.timedelta(hours=h)
    axis = pit.sessions(spark.createDataFrame([(t(0),), (t(1),), (t(4),)], "day timestamp_ntz"))
    facts = spark.createDataFrame([(1, t(0), t(90)), (2, t(1), t(90)), (3, t(2), t(3)), (4, t(4), t(90)), (5, t(0), t(1, 2))], "id int, day timestamp_ntz, knowable_at timestamp_ntz")
    got = {r.id: (r.knowable_at, r.knowable_basis) for r in R.next_session_live(facts, axis, 3 * 3600).collect()}
    assert got == {1: (t(1, 3), "ASSUMED"), 2: (t(4, 3), "ASSUMED"), 3: (t(3), "OBSERVED"), 4: (t(90), "OBSERVED"), 5: (t(1, 2), "OBSERVED")}
    events = spark.createDataFrame([(1, t(5), t(2), t(50)), (2, None, t(2), t(50)), (3, t(5), t(9), t(50)), (4, t(5), t(2), t(3))], "id int, ex_at timestamp_ntz, knowable_at timestamp_ntz, fetched_at timestamp_ntz")
    got = {r.id: r.knowable_at for r in R.event_live(events, 3600).collect()}
    assert got == {1: t(5, 1), 2: t(50), 3: t(9), 4: t(3)}


def test_facts_are_never_broadcast(spark, tmp_path):
    # the file of the facts is the smaller one, what they are laid out to is not
    spark.range(50).selectExpr("id AS k", "id AS no", "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS knowable_at").write.parquet(str(tmp_path / "facts"))
    instants = spark.range(2000).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS as_of", "id AS previous_session", "repeat('x', 100) AS more")
    instants.write.parquet(str(tmp_path / "instants"))
    got = R.versions(spark.read.parquet(str(tmp_path / "facts")), spark.read.parquet(str(tmp_path / "instants")), ["k"], ["no"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert got.count() == sum(max(0, 1999 - 24 * i) for i in range(50))


def test_bars_are_laid_out_behind_the_shuffle(spark):
    bars, index = _bars(spark, ["a", "b"], 40, 4), _bars(spark, ["i"], 40, 5)
    _, instants = _instants(spark, 20, 30, 41)
    got = R.replay_bars(bars, index, instants, names=("ret_1d", "sma_20"), others=("beta_60",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Exchange hashpartitioning" not in plan[: plan.index("Generate explode")]
    rows = [(r.as_of, r.key, r.feature_id, r.value, r.reason) for r in got.collect()]
    every = [(r.as_of, r.key, r.feature_id, r.value, r.reason) for r in R.replay_bars(bars, index, instants).where("feature_id IN ('ret_1d', 'sma_20', 'beta_60')").collect()]
    assert sorted(rows, key=str) == sorted(every, key=str) and len(rows) == 18


def _odd_bars(spark, keys, days, seed, late=0.1, again=0.1, values=True):
    """Bars of a day, some missing, some known late, some revised, some of values that features refuse."""
    rng, rows = random.Random(seed), []
    for k in keys:
        price = 100.0
        for d in range(days):
            if rng.random() < 0.05:
                continue
            price *= 1 + rng.uniform(-0.05, 0.05)
            close = rng.choice([0.0, -1.0, None, float("nan")]) if values and rng.random() < 0.01 else price
            known = START + (d + 1) * DAY + (rng.randrange(15) * DAY if rng.random() < late else 0 * DAY)
            for version in range(2 if rng.random() < again else 1):
                rows.append((k, START + d * DAY, price, price * 1.01, price * 0.99, close if version == 0 else price * 1.02, 100 + d, known + version * rng.randrange(4) * DAY, version))
    return spark.createDataFrame(rows, "key string, bucket timestamp_ntz, open double, high double, low double, close double, volume long, knowable_at timestamp_ntz, version int")


def _after(spark, *days):
    """Instants whose previous session is the day before, the last that a bar in time is of."""
    return spark.createDataFrame([(START + d * DAY + dt.timedelta(hours=9), START + (d - 1) * DAY) for d in days], "as_of timestamp_ntz, previous_session timestamp_ntz")


def _same_both_ways(bars, index, instants, history, names=snapshot.STOCK_FEATURES, others=("volatility_20", "beta_60")):
    spark = bars.sparkSession
    keys = [r.key for r in bars.select("key").distinct().collect()]
    sectors = spark.createDataFrame([(k, "x") for k in keys if k], "key string, sector string")
    columns = ["as_of", "scope", "key", "feature_id", "value", "reason"]
    both = [R.replay_bars(bars, index, instants, sectors, history, names, 7 * 86_400, others, provenance=p).select(*columns).collect() for p in (False, True)]
    made, laid = (sorted((str(tuple(r)) for r in rows)) for rows in both)
    assert made == laid and len(made) > 0
    return both[0]


def test_features_of_bars_are_those_of_pairs(spark):
    instants = _after(spark, 0, 1, 3, 25, 40, 66, 67, 90, 101, 119, 120, 135, 190, 400)
    index = _odd_bars(spark, ["i"], 120, 6, late=0, again=0, values=False)
    for seed, late, again in ((1, 0, 0), (2, 0.02, 0.01), (3, 0.3, 0.3)):
        bars = _odd_bars(spark, ["a", "b", "c", "d", "e", None], 120, seed, late, again)
        rows = _same_both_ways(bars, index, instants, 80)
        assert {r.reason for r in rows if r.feature_id == "beta_60"} >= {None, "INSUFFICIENT_HISTORY", "MISSING_INPUT"}
        assert {r.feature_id for r in rows if r.value is not None} >= {"ret_20d", "breakout_20", "volatility_20", "beta_60", "sector_rs_20"}
    # a bar without a bucket, and one that nothing knows
    more = spark.createDataFrame([("a", None, 1.0, 1.0, 1.0, 1.0, 1, START + 30 * DAY, 0), ("b", START + 500 * DAY, 1.0, 1.0, 1.0, 1.0, 1, None, 0)], bars.schema)
    _same_both_ways(_odd_bars(spark, ["a", "b", "c"], 90, 7, 0, 0).union(more), index, instants, 80)
    assert R.replay_bars(bars, index, instants.where("false"), provenance=False, others=("beta_60",)).count() == 0
    assert R.replay_bars(bars.where("false"), index, instants, provenance=False, others=("beta_60",)).count() == 0


def test_features_of_bars_with_another_index(spark):
    instants = _after(spark, 66, 67, 90, 100, 119, 120, 121)
    bars = _odd_bars(spark, ["a", "b", "c", "d"], 120, 8, 0, 0)
    plain = _odd_bars(spark, ["i"], 120, 9, late=0, again=0, values=False)
    later = lambda d: plain.withColumn("knowable_at", F.expr(f"knowable_at + INTERVAL '{d}' DAY"))
    some = (later(1), later(5), later(-1), plain.where("bucket < '2024-03-20'"), plain.where("day(bucket) > 2"), _odd_bars(spark, ["i"], 120, 10, 0.2, 0.2), plain.where("false"))
    for i, index in enumerate(some):
        _same_both_ways(bars, index, instants, (75, 62, 450)[i % 3], ("ret_1d", "ret_20d"), ("beta_60",))


def test_bars_that_are_known_in_order_are_not_laid_out(spark):
    from tidewater.plans import replays

    plan = replays.replay_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # every window over bars is one of a key: none of a key at an instant, which would have each bar as often as it is seen
    assert re.search(r"Window \[.*\], \[key#\w+\]", plan) and not re.search(r"Window \[.*\], \[key#\w+, as_of#", plan)


def test_odd_pairs_alone_are_laid_out(spark):
    instants = _after(spark, 10, 12, 20, 30)
    bars = _odd_bars(spark, ["a", "b"], 40, 11, 0, 0).where("NOT (key = 'a' AND bucket >= '2024-01-11' AND bucket < '2024-01-13')")
    late = spark.createDataFrame([("a", START + 10 * DAY, 1.0, 1.0, 1.0, 1.0, 1, START + 14 * DAY, 0), ("a", START + 11 * DAY, 1.0, 1.0, 1.0, 1.0, 1, START + 12 * DAY, 0)], bars.schema)
    twice = spark.createDataFrame([("b", START + 50 * DAY, 1.0, 1.0, 1.0, 1.0, 1, START + d * DAY, v) for v, d in ((0, 15), (1, 21))], bars.schema)
    odd = R._odd_pairs(R._prefixes(bars.union(late).union(twice)), instants, 450, 86_400, False).collect()
    at = lambda d: START + d * DAY + dt.timedelta(hours=9)
    assert {(r.key, r.as_of) for r in odd} >= {("a", at(12)), ("b", at(20))} and ("a", at(10)) not in {(r.key, r.as_of) for r in odd}
    assert not {("a", at(20)), ("a", at(30)), ("b", at(10)), ("b", at(12))} & {(r.key, r.as_of) for r in odd}


def test_depth_is_where_a_feature_has_a_history(spark):
    rows = [("k", START + d * DAY, 10.0 + d % 7, 12.0 + d % 7, 9.0 + d % 7, 10.0 + d % 5, 100 + d) for d in range(260)]
    bars = spark.createDataFrame(rows, "key string, bucket timestamp_ntz, open double, high double, low double, close double, volume long")
    made = B.with_volatility(B.features(bars)).orderBy("bucket").collect()
    first = {n: next(i for i, r in enumerate(made, 1) if r[n].reason is None) for n in B.DEPTHS}
    assert first == B.DEPTHS and set(B.DEPTHS) == {*B.FEATURES, "volatility_20"}
