from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_EVEN, Decimal, localcontext
from fractions import Fraction

from pyspark.sql import functions as F

from tidewater.operators import basis as B

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
AT = lambda n, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)


def test_factors(spark):
    rows = [("SPLIT", None, None, 10, 2), ("SPLIT", 2, 10, 10, 2), ("SPLIT", 1, 10, 10, 2), ("SPLIT", 1, 5, None, 2), ("BONUS", 1, 2, None, None), ("BONUS", 0, 2, None, None), ("RIGHTS", 1, 2, None, None), ("DIVIDEND", None, None, None, None), (None, 1, 1, 1, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, a int, b int, f int, t int")
    got = df.select("i", B.factor_of(*(F.col(c) for c in "kabft")).alias("f")).orderBy("i").select("f.*").collect()
    assert [(r.status, r.num, r.den) for r in got] == [("EXACT", 10, 2), ("EXACT", 10, 2), ("UNCERTAIN", None, None), ("UNCERTAIN", None, None), ("EXACT", 3, 2), ("UNCERTAIN", None, None)] + [("UNSUPPORTED", None, None)] * 3
    assert all((r.reason is None) == (r.status == "EXACT") for r in got)


def test_treatments(spark):
    rows = [(None, 1, 100.0, 50.0, None, 0), (2, 1, 100.0, 50.0, D(-1), 0), (2, 1, 100.0, 50.0, D(5), 0), (2, 1, 100.0, 101.0, D(5), 0), (2, 1, 100.0, 70.0, D(5), 0), (2, 1, None, 70.0, None, 0), (2, 1, 100.0, None, D(5), 0), (11, 10, 100.0, 91.0, D(5), 0), (2, 1, 100.0, 50.0, D(-1), 3), (2, 1, 100.0, 50.0, None, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n int, d int, pc double, eo double, pb date, obs int")
    got = df.select("i", B.treatment(F.col("n"), F.col("d"), F.col("pc"), F.col("eo"), F.col("pb"), F.lit(D(0)), F.col("obs")).alias("t")).orderBy("i").collect()
    assert [r.t.state for r in got] == ["N/A", "UNKNOWN", "NOT_APPLIED", "APPLIED", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "APPLIED", "NOT_APPLIED"]


def test_running_products_are_exact(spark):
    rng = random.Random(1)
    rows = [(k, o, rng.randrange(1, 7)) for k in ("a", "b", "c") for o in range({"a": 1, "b": 7, "c": 33}[k])]
    got = B.running_products(spark.createDataFrame(rows, "k string, o int, n int"), ["k"], ["o"], ["n"]).collect()
    for r in got:
        want = 1
        for k, o, n in rows:
            want *= n if k == r.k and o <= r.o else 1
        assert int(r.n) == want
    assert B.running_products(spark.createDataFrame([], "k string, o int, n int"), ["k"], ["o"], ["n"]).count() == 0


def test_rounding_against_fractions(spark):
    rng = random.Random(2)
    rows = [(round(rng.uniform(-900, 900), 2), rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(300)] + [(0.000005, 2, 1), (0.000015, 10, 1), (1.5, 1_000_000, 1)]
    got = spark.createDataFrame(rows, "v double, n int, d int").select("*", B.over_ratio(F.col("v"), F.col("n"), F.col("d")).alias("o")).collect()
    for r in got:
        exact = Fraction(Decimal(str(r.v))) * r.d / r.n
        with localcontext() as c:
            c.prec = 60
            want = Decimal(round(abs(exact) * 10**6)) / 10**6  # round() takes halves to the even
        assert abs(r.o) == want.quantize(Decimal("0.000001"), ROUND_HALF_EVEN), r


def test_conventions(spark):
    def made(raw, n, d, mode):
        tick = Fraction(1, 20)
        if mode == "exact":
            return [float(round(Fraction(Decimal(str(x))) * d / n / tick) * tick) for x in raw[:2]] + [int(raw[2] * n / d)]
        m = Fraction((Decimal(d) / Decimal(n)).quantize(Decimal("0.0001"), "ROUND_HALF_UP"))
        return [float(round(Fraction(Decimal(str(x))) * m / tick) * tick) for x in raw[:2]] + [int(Decimal(raw[2]) / Decimal(m.numerator) * Decimal(m.denominator) + Decimal("0.5"))]

    rows = []
    for i in range(40):
        raw = (round(100 + i * 3.35, 2), round(250 + i * 1.15, 2), 6000 + 30 * i)
        for n, d in ((2, 1), (3, 2), (10, 1)):
            for mode in ("exact", "reciprocal-4dp", "none"):
                new = made(raw, n, d, mode if mode != "none" else "exact")
                said = None if mode == "none" else "exact" if new == made(raw, n, d, "exact") else mode
                rows.append((*raw, n, d, round(new[0] + (0.35 if mode == "none" else 0), 2), new[1], new[2], said))
    assert {r[-1] for r in rows} == {None, "exact", "reciprocal-4dp"}
    df = spark.createDataFrame(rows, "open double, close double, volume long, num int, den int, new_open double, new_close double, new_volume long, mode string")
    for r in df.withColumn("got", B.convention(df, ("open", "close"), 0.05)).collect():
        assert r.got == r.mode, r
    same = spark.createDataFrame([(1.0, None, 1.0, None), (1.0, 2.0, 1.0, None), (1.10, 2.0, 1.1, 2.00)], "a_x double, a_y double, b_x double, b_y double").select(B.same_observation("a_", "b_", ("x", "y")).alias("s"))
    assert [r.s for r in same.collect()] == [True, False, True]


def _known(bars, factors, basis, excluded, instant):
    """The contract, a bar at a time, by fractions."""
    out = {}
    horizon = min((f["ex"] for f in factors if f["known"] < instant), default=None)
    for b in bars:
        if b["known"] >= instant:
            continue
        kind, until = basis.get(b["payload"], (None, None))
        mine = [f for f in factors if f["key"] == b["key"] and f["status"] == "EXACT" and b["day"] < f["ex"]]
        target = baked = Fraction(1)
        low = kind is None
        for f in mine:
            if f["ex"] <= instant.date() and f["known"] < instant:
                target *= Fraction(f["num"], f["den"])
            if kind == "VENDOR_ADJUSTED" and f["ex"] <= until:
                if f["treatment"] == "APPLIED" and (b["payload"], f["id"]) not in excluded:
                    baked *= Fraction(f["num"], f["den"])
                low |= f["treatment"] == "UNKNOWN"
        low |= kind == "VENDOR_ADJUSTED" and (horizon is None or b["day"] < horizon)
        net = target / baked
        status = "AS_STORED" if net == 1 else "ADJUSTED" if net > 1 else "RECONSTRUCTED"
        out[b["key"], b["day"]] = (net, status, "LOW" if low else "HIGH", "low_confidence" if low else "reconstructed" if net < 1 else None)
    return out


def test_bars_as_known_against_fractions(spark):
    rng = random.Random(7)
    factors = [
        {"key": k, "id": i * 10 + j, "ex": D(rng.randrange(60)), "known": AT(rng.randrange(-5, 65)), "status": rng.choice(["EXACT"] * 4 + ["UNCERTAIN"]), "num": rng.choice([2, 3, 5, 1]), "den": rng.choice([1, 1, 2]), "treatment": rng.choice(["APPLIED"] * 3 + ["NOT_APPLIED", "UNKNOWN"])}
        for i, k in enumerate("abcd") for j in range({"a": 0, "b": 1, "c": 4, "d": 9}[k])
    ]
    bars = [{"key": k, "day": D(n), "payload": f"{k}{n // 20}", "known": AT(n + 1, rng.randrange(30))} for k in "abcd" for n in range(60)]
    basis = {p: (rng.choice(["VENDOR_ADJUSTED"] * 3 + ["RAW_OBSERVED"]), D(rng.randrange(70))) for p in {b["payload"] for b in bars} if p != "b2"}
    excluded = {(f"{f['key']}{n}", f["id"]) for f in factors for n in range(3) if rng.random() < 0.4}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    b = df([(x["key"], x["day"], 10.0, 12.0, 9.0, 11.0, 300, x["payload"], x["known"]) for x in bars], "key string, day date, open double, high double, low double, close double, volume long, payload string, knowable_at timestamp_ntz")
    f = df([(x["key"], x["id"], x["ex"], x["known"], x["status"], *((x["num"], x["den"]) if x["status"] == "EXACT" else (None, None)), x["treatment"]) for x in factors], "key string, action_id long, ex_date date, knowable_at timestamp_ntz, status string, num long, den long, treatment string")
    p = df([(k, *v) for k, v in basis.items()], "payload string, price_basis string, basis_as_of date")
    x = df(sorted(excluded) * 2, "payload string, action_id long")
    for day in (0, 25, 58, 90):
        instant = AT(day, 9)
        got = {(r.key, r.day): (Fraction(int(r.num), int(r.den)), r.status, r.confidence, r.refusal) for r in B.bars_as_known(b, f, p, x, F.lit(instant).cast("timestamp_ntz")).collect()}
        assert got == _known(bars, factors, basis, excluded, instant)
    rows = B.bars_as_known(b, f, p, x, F.lit(AT(58, 9)).cast("timestamp_ntz"), allow_reconstructed=True)
    for r in rows.where("refusal IS NULL").collect():
        assert r.close == round(11 * Decimal(int(r.den)) / Decimal(int(r.num)), 6) and r.volume == round(300 * Decimal(int(r.num)) / Decimal(int(r.den)), 6)
    counted = {r.key: (r.reconstructed, r.low_confidence) for r in B.refused(rows).collect()}
    assert counted["a"][0] == 0 and sum(c[1] for c in counted.values()) == rows.where("refusal = 'low_confidence'").count()
    none = B.bars_as_known(b, f.where("false"), p, x, F.lit(AT(58, 9)).cast("timestamp_ntz"))
    assert {r.status for r in none.collect()} == {"AS_STORED"}


def test_ratios_in_longs_equal_those_in_decimals(spark):
    rng = random.Random(5)
    rows = [(round(rng.uniform(-900, 900), 2), rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(200)] + [(0.000005, 2, 1), (0.000015, 10, 1), (-0.000015, 10, 1), (9e12, 7, 3), (9e13, 3, 7), (4e7, 1, 10**10), (None, 2, 1), (0.0, 5, 9)]
    df = spark.createDataFrame(rows, "v double, n long, d long").selectExpr("v", "CAST(n AS DECIMAL(38,0)) AS num", "CAST(d AS DECIMAL(38,0)) AS den", "n AS _num", "d AS _den")
    df = df.withColumn("_m_v", B._micro(F.col("v")).try_cast("long"))
    got = df.select(B._over_long("v", "num", "den").alias("a"), B.over_ratio(F.col("v"), F.col("num"), F.col("den")).alias("b")).collect()
    assert len(got) == len(rows) and all(r.a == r.b for r in got)


def test_bars_are_made_once(spark):
    from tidewater.plans import replays

    for query in (replays.bars_on_known_basis, replays.refused_bars):
        read = query(spark, "/root/testdata/sf0.001").inputFiles()
        assert read and not any("lineitem" in f for f in read)  # what is read several times is stored, no lookup rolls the lines up again
