"""Queries over a panel of weekly supplier bars and over hourly slots: signals, universes, arms, exits, breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import books
from ..operators import crosssection as X
from .derive import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier: prices are unit prices of its lines, the volume their quantity."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 7).cast("int").alias("i"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"),
        (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("p"), F.col("l_quantity").cast("double").alias("q"),
    )
    # a week holds few lines of a supplier, so partial sums would save nothing: the lines go to their key once, and its windows find them there
    return line.repartition("key").groupBy("key", "i").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("q").alias("volume"))


PANEL_SQL = """panel AS (SELECT l_suppkey AS key, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS INTEGER) AS i, first(l_extendedprice::DOUBLE / l_quantity::DOUBLE ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open,
 max(l_extendedprice::DOUBLE / l_quantity::DOUBLE) AS high, min(l_extendedprice::DOUBLE / l_quantity::DOUBLE) AS low, last(l_extendedprice::DOUBLE / l_quantity::DOUBLE ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, sum(l_quantity::DOUBLE) AS volume FROM lineitem GROUP BY 1, 2)"""

_R = "max({c}) OVER (PARTITION BY key ORDER BY i RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"
_BEFORE = _R.format(c="close", n=1)
_SUSPECT = "(abs(close / pc - 1) > 20 OR abs(open / pc - 1) > 20)"
_BASE = f"WITH {PANEL_SQL}, b AS (SELECT *, {_BEFORE} AS pc FROM panel)"


@query(_BASE + f""", f AS (SELECT *, {_R.format(c='close', n=4)} / {_R.format(c='close', n=52)} - 1 AS m, max(high) OVER (PARTITION BY key ORDER BY i RANGE BETWEEN 51 PRECEDING AND CURRENT ROW) AS top,
 {_R.format(c='volume', n=1)} AS lv, avg(volume) OVER w AS mv, count(volume) OVER w AS nv, median(close * volume) OVER t AS mt, count(*) OVER t AS nt, list(ln(close)) OVER (PARTITION BY key ORDER BY i RANGE BETWEEN 26 PRECEDING AND CURRENT ROW) AS c
 FROM b WINDOW w AS (PARTITION BY key ORDER BY i RANGE BETWEEN 21 PRECEDING AND 2 PRECEDING), t AS (PARTITION BY key ORDER BY i RANGE BETWEEN 12 PRECEDING AND CURRENT ROW))
SELECT key, i, round(m, 6) AS momentum, round(CASE WHEN i >= 51 THEN close / top END, 6) AS proximity, round(open / pc - 1, 6) AS gap, round(CASE WHEN nv >= 10 AND lv > 1.2 * mv THEN open / pc - 1 END, 6) AS gap_and_go, high = low AS locked,
 coalesce({_SUSPECT}, false) AS suspect, round(CASE WHEN nt >= 6 THEN mt END + 1e-6, 2) AS turnover, round(CASE WHEN len(c) >= 13 THEN list_stddev_pop(list_transform(range(2, len(c) + 1), lambda j: c[j] - c[j - 1])) END, 6) AS volatility FROM f""")
def panel_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    got = {"momentum": X.momentum(52, 4), "proximity": X.high_proximity(52), "gap": X.gap(), "gap_and_go": X.gap_and_go(20, 1.2), "locked": X.locked(), "suspect": X.suspect(threshold=20.0), "turnover": X.median_turnover(13), "volatility": X.log_volatility(26)}
    got["turnover"] = got["turnover"] + 1e-6  # off the halves that sums of two decimals round on
    digits = {"turnover": 2}
    return p.select("key", "i", *[c.alias(n) if n in ("locked", "suspect") else F.round(c, digits.get(n, 6)).alias(n) for n, c in got.items()])


_ELIGIBLE = _BASE + f""", s AS (SELECT *, coalesce({_SUSPECT}, false) AS suspect FROM b), f AS (SELECT *, max(suspect::INTEGER) OVER (PARTITION BY key ORDER BY i RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS tainted, count(*) OVER (PARTITION BY key ORDER BY i) AS history,
 median(close * volume) OVER t AS mt, count(*) OVER t AS nt, list(ln(close)) OVER (PARTITION BY key ORDER BY i RANGE BETWEEN 26 PRECEDING AND CURRENT ROW) AS c FROM s WINDOW t AS (PARTITION BY key ORDER BY i RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)),
e AS (SELECT i, key, mt AS turnover, list_stddev_pop(list_transform(range(2, len(c) + 1), lambda j: c[j] - c[j - 1])) AS volatility FROM f WHERE close >= 200 AND history >= 26 AND tainted = 0 AND nt >= 6 AND len(c) >= 13),
universe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY turnover DESC, key) AS place FROM e) WHERE place <= 40)"""


def _universe(spark, sf_dir):
    return X.eligible(panel(spark, sf_dir), top=40, min_history=26, min_price=200.0, lookback=8, threshold=20.0, turnover_window=13, vol_window=26)


@query(_ELIGIBLE + " SELECT i, key, CAST(place AS INTEGER) AS place, round(turnover + 1e-6, 2) AS turnover, round(volatility, 6) AS volatility FROM universe")
def panel_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).select("i", "key", "place", F.round(F.col("turnover") + 1e-6, 2).alias("turnover"), F.round("volatility", 6).alias("volatility"))


def _bins(value: str, n: int) -> str:
    unit = f"CASE WHEN count(*) OVER (PARTITION BY i) < 2 THEN 0 ELSE (rank() OVER (PARTITION BY i ORDER BY {value}) + (count(*) OVER (PARTITION BY i, {value}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY i) - 1) - 0.5 END"
    return f"CAST(floor(least(({unit} + 0.5) * {n}, {n} - 1e-9)) AS INTEGER)"


_HASH = "('0x' || substr(md5({parts}), 1, 13))::BIGINT"
_ARMS = _ELIGIBLE + f""", u0 AS (SELECT u.*, {_bins('turnover', 3)} AS ct, {_bins('volatility', 3)} AS cv, -gap AS score FROM universe u JOIN (SELECT key, i, open / pc - 1 AS gap FROM b) g USING (key, i)),
u1 AS (SELECT *, score IS NOT NULL AND row_number() OVER (PARTITION BY i ORDER BY score DESC NULLS LAST, key) <= 5 AS picked FROM u0),
u AS (SELECT *, NOT picked AND row_number() OVER (PARTITION BY i ORDER BY picked, {_HASH.format(parts="concat_ws(':', 11, 'placebo', i, key)")}, key) <= count(*) FILTER (WHERE picked) OVER (PARTITION BY i) AS placebo FROM u1),
ch AS (SELECT i, ct, cv, key, row_number() OVER (PARTITION BY i, ct, cv ORDER BY key) AS n FROM u WHERE picked), po AS (SELECT i, ct, cv, key, row_number() OVER (PARTITION BY i, ct, cv ORDER BY {_HASH.format(parts="concat_ws(':', 11, i, key)")}, key) AS n FROM u WHERE NOT picked),
ch2 AS (SELECT i, ct, cv, key, row_number() OVER (PARTITION BY i, ct, cv ORDER BY key) AS n FROM u WHERE placebo), po2 AS (SELECT i, ct, cv, key, row_number() OVER (PARTITION BY i, ct, cv ORDER BY {_HASH.format(parts="concat_ws(':', 12, i, key)")}, key) AS n FROM u WHERE NOT placebo AND NOT picked),
arms AS (SELECT i, 'P' AS arm, key FROM u WHERE picked UNION ALL SELECT i, 'C2', po.key FROM ch JOIN po USING (i, ct, cv, n) UNION ALL SELECT i, 'PL', key FROM u WHERE placebo UNION ALL SELECT i, 'PLC', po2.key FROM ch2 JOIN po2 USING (i, ct, cv, n) UNION ALL SELECT i, 'C0', key FROM u)"""


def _arms(spark, sf_dir):
    score = panel(spark, sf_dir).select("key", "i", (-X.gap()).alias("score"))
    return X.form_arms(_universe(spark, sf_dir).join(score, ["key", "i"]), "score", 5, 11, 3, 3)


@query(_ARMS + " SELECT i, arm, key FROM arms")
def panel_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir)


_MIS = books.Rates(brokerage_flat=20.0, brokerage_share=0.0006, stt_buy=0.0, stt_sell=0.00025, stamp_buy=0.00003, exchange=0.0000307, sebi=0.000001, gst=0.18, depository_sell=0.0)
_FEE = "CASE WHEN {v} > 0 THEN least(20.0, 0.0006 * {v}) * 1.18 + {v} * 0.0000317 * 1.18 + {v} * {tax} ELSE 0 END + {v} * 5 / 10000.0"


@query(_ARMS + f""", r AS (SELECT key, i, close / open - 1 AS r FROM panel WHERE open > 0 AND close > 0), g AS (SELECT a.i, a.arm, avg(r.r) AS gross FROM arms a JOIN r USING (i, key) GROUP BY 1, 2),
v AS (SELECT a.i, r.r, 1000000.0 / count(*) OVER (PARTITION BY a.i) AS v FROM arms a JOIN r USING (i, key) WHERE arm = 'P'), c AS (SELECT i, sum({_FEE.format(v='v', tax='0.00003')} + {_FEE.format(v='(v * (1 + r))', tax='0.00025')}) / 1000000 AS cost FROM v GROUP BY 1),
w AS (SELECT i, max(gross) FILTER (WHERE arm = 'P') AS p, max(gross) FILTER (WHERE arm = 'C2') AS c2, max(gross) FILTER (WHERE arm = 'PL') AS pl, max(gross) FILTER (WHERE arm = 'PLC') AS plc, max(gross) FILTER (WHERE arm = 'C0') AS c0 FROM g GROUP BY 1)
SELECT w.i, round(p, 6) AS p_gross, round(c2, 6) AS c2_gross, round(coalesce(cost, 0), 6) AS cost, round(p - coalesce(cost, 0) - c2, 6) AS s, round(pl - plc, 6) AS placebo, round(c0, 6) AS c0_gross FROM w LEFT JOIN c ON c.i = w.i""")
def primary_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = _arms(spark, sf_dir)
    r = panel(spark, sf_dir).where("open > 0 AND close > 0").select("key", "i", (F.col("close") / F.col("open") - 1).alias("r"))
    costs = books.session_costs(arms.where("arm = 'P'").join(r, ["i", "key"]).select("i", "key", "r"), "i", 1_000_000.0, 5.0, rates=_MIS)
    got = X.primary_series(X.arm_returns(arms, r), costs)
    return got.select("i", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


@query(f"""WITH {PANEL_SQL}, w AS (SELECT *, row_number() OVER k AS n, lag(close) OVER k AS pc, avg(close) OVER (PARTITION BY key ORDER BY i ROWS 9 PRECEDING) AS m, max(close) OVER (PARTITION BY key ORDER BY i ROWS 7 PRECEDING) AS hi, min(close) OVER (PARTITION BY key ORDER BY i ROWS 7 PRECEDING) AS lo FROM panel WINDOW k AS (PARTITION BY key ORDER BY i))
SELECT i, count(*) AS names, count(*) FILTER (WHERE close > pc) AS advances, count(*) FILTER (WHERE close < pc) AS declines, count(*) FILTER (WHERE close = pc) AS unchanged, round(avg(CASE WHEN n >= 10 THEN (close > m)::INTEGER END), 6) AS above_mean,
 round(CASE WHEN count(*) FILTER (WHERE close <> pc) > 0 THEN count(*) FILTER (WHERE close > pc) / count(*) FILTER (WHERE close <> pc) END, 6) AS ad_ratio, round((count(*) FILTER (WHERE n >= 8 AND close >= hi) - count(*) FILTER (WHERE n >= 8 AND close <= lo)) / count(*), 6) AS nh_nl FROM w GROUP BY 1""")
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = X.breadth(panel(spark, sf_dir), 10, 8)
    return got.select("i", "names", "advances", "declines", "unchanged", *[F.round(c, 6).alias(c) for c in ("above_mean", "ad_ratio", "nh_nl")])


@query(f"""WITH {PANEL_SQL}, d AS (SELECT i, DATE '1992-01-01' + CAST(i * 7 AS INTEGER) AS day FROM (SELECT DISTINCT i FROM panel)), n AS (SELECT row_number() OVER (ORDER BY day) - 1 AS j, day FROM d), f AS (SELECT j FROM (SELECT j, day, lag(day) OVER (ORDER BY day) AS b FROM n) WHERE date_trunc('month', day) > date_trunc('month', b))
SELECT CAST(formation AS INTEGER) AS formation, CAST(entry AS INTEGER) AS entry, CAST(x AS INTEGER) AS exit FROM (SELECT j - 1 AS formation, j AS entry, lead(j) OVER (ORDER BY j) AS x FROM f) WHERE x IS NOT NULL""")
def month_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = panel(spark, sf_dir).select("i").distinct().select(F.expr("date_add(DATE'1992-01-01', i * 7)").alias("day"))
    axis = days.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)  # a calendar
    return X.month_plan(axis)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour slots of each event type's days."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.datediff("ts", F.lit("2024-01-01")).alias("i"), F.floor(F.hour("ts") / 6).cast("int").alias("slot"), F.struct("ts", "event_id").alias("at"), "value")
    return e.groupBy("key", "i", "slot").agg(F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").alias("volume"))


SLOTS_SQL = """slots AS (SELECT event_type AS key, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS i, CAST(hour(ts) // 6 AS INTEGER) AS slot, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2, 3),
regular AS (SELECT i FROM slots WHERE key = 'view' GROUP BY i HAVING count(DISTINCT slot) = 4)"""


@query(f"""WITH {SLOTS_SQL}, n AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM regular), days AS (SELECT d.i, (SELECT count(*) FROM regular q WHERE q.i < d.i) AS seen FROM (SELECT DISTINCT i FROM slots) d), f AS (SELECT * FROM slots WHERE slot = 0 AND open > 0),
h AS (SELECT f.key, f.i, f.open, f.close, f.volume, d.seen, (SELECT count(*) FROM f g JOIN n ON n.i = g.i WHERE g.key = f.key AND n.r BETWEEN d.seen - 4 AND d.seen) AS c, (SELECT avg(g.volume) FROM f g JOIN n ON n.i = g.i WHERE g.key = f.key AND n.r BETWEEN d.seen - 4 AND d.seen) AS m FROM f JOIN days d ON d.i = f.i),
dl AS (SELECT key, i, avg(open) AS o FROM slots WHERE open > 0 GROUP BY 1, 2)
SELECT h.key, h.i, h.i IN (SELECT i FROM regular) AS regular, abs(h.open / dl.o - 1) <= 0.3 AS consistent, round(CASE WHEN h.close > 0 THEN h.close / h.open - 1 END, 6) AS first_return, round(CASE WHEN seen >= 5 AND c >= 3 THEN h.volume / m END, 6) AS relative_volume FROM h JOIN dl ON dl.key = h.key AND dl.i = h.i""")
def first_slot_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir)
    regular = X.regular_sessions(s, "view", 4)
    daily = s.where("open > 0").groupBy("key", "i").agg(F.avg("open").alias("open"))
    got = X.first_slot_signals(s, regular, 5, 3).join(X.open_consistent(s, daily, 0.3), ["key", "i"])
    got = got.join(F.broadcast(regular.withColumn("regular", F.lit(True))), "i", "left")
    return got.select("key", "i", F.coalesce("regular", F.lit(False)).alias("regular"), "consistent", F.round("first_return", 6).alias("first_return"), F.round("relative_volume", 6).alias("relative_volume"))


@query(f"""WITH {SLOTS_SQL}, e AS (SELECT key, i, open AS entry, 0.3 AS sigma FROM slots WHERE slot = 0 AND open > 0), s AS (SELECT e.key, e.i, entry, slot, open, high, low, close, entry * 1.6 AS t, entry * 0.4 AS p FROM e JOIN slots USING (key, i) WHERE slot <= 3 AND open > 0),
x AS (SELECT DISTINCT ON (key, i) key, i, CASE WHEN low <= p AND high >= t THEN 'both' WHEN low <= p THEN 'stop' ELSE 'target' END AS how, CASE WHEN low <= p THEN least(p, open) ELSE greatest(t, open) END AS px FROM s WHERE slot < 3 AND (low <= p OR high >= t) ORDER BY key, i, slot),
a AS (SELECT key, i, coalesce(max(open) FILTER (WHERE slot = 3), last(close ORDER BY slot) FILTER (WHERE slot < 3 AND close > 0)) AS te FROM s GROUP BY 1, 2)
SELECT a.key, a.i, round(te, 6) AS time_exit, round(CASE WHEN x.how IS NULL THEN te ELSE px END, 6) AS exit, coalesce(x.how, 'time') AS how FROM a LEFT JOIN x ON x.key = a.key AND x.i = a.i""")
def session_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir)
    entries = s.where("slot = 0 AND open > 0").select("key", "i", F.col("open").alias("entry"), F.lit(0.3).alias("sigma"))
    got = X.session_exits(entries, s, 0, 3, 2.0)
    return got.select("key", "i", F.round("time_exit", 6).alias("time_exit"), F.round("exit", 6).alias("exit"), "how")


@query("""WITH m AS (SELECT l_suppkey % 10 AS session, l_partkey AS key, avg(l_discount) - 0.05 AS exp_return, avg(l_tax) * 12 AS prob, max(l_returnflag) = 'R' AS results_today FROM lineitem GROUP BY 1, 2)
SELECT session, key, CAST(place AS INTEGER) AS place, round(exp_return, 6) AS exp_return FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(exp_return, 9) DESC, key) AS place FROM m WHERE round(exp_return, 9) > 0.002 AND prob > 0.5 AND NOT results_today) WHERE place <= 8""")
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("session"), F.col("l_partkey").alias("key")).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("exp_return"), (F.avg("l_tax") * 12).alias("prob"), (F.max("l_returnflag") == "R").alias("results_today"))
    return X.select_models(m, ["session"], F.lit(0.002), 8).select("session", "key", "place", F.round("exp_return", 6).alias("exp_return"))
