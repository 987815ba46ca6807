"""Queries over bars and cross-sections: point-in-time reads, window features, folds, ranks, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reasons import digits12, sql_round
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import orderstats, pit, ranks
from .derive import ACTIONS_SQL, KNOWN_SQL, MONTHLY_SQL, actions, bars, bars_sql, known_bars, monthly, table

#: The instant of the point-in-time reads.
AS_OF = "2024-01-20 12:00:00"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _instant():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _text(*columns: str) -> list:
    return [F.col(c).cast("string").alias(c) for c in columns]


def _rounded(name: str):
    return F.round(F.col(f"{name}.value"), 6).alias(name), F.col(f"{name}.reason").alias(f"{name}_reason")


@query(f"WITH {bars_sql()} SELECT key, CAST(bucket AS VARCHAR) AS bucket, open, high, low, close, volume FROM bars")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("key", *_text("bucket"), "open", "high", "low", "close", "volume")


@query(f"WITH {KNOWN_SQL} SELECT key, CAST(bucket AS VARCHAR) AS bucket, close FROM known WHERE knowable_at < TIMESTAMP '{AS_OF}'")
def asof_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.as_of(known_bars(spark, sf_dir), _instant()).select("key", *_text("bucket"), "close")


@query(f"""WITH {KNOWN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bucket DESC) AS recency FROM known WHERE knowable_at < TIMESTAMP '{AS_OF}')
SELECT key, CAST(bucket AS VARCHAR) AS bucket, close, CAST(recency AS INTEGER) AS recency FROM r WHERE recency <= 20""")
def last_n_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.last_n(pit.as_of(known_bars(spark, sf_dir), _instant()), ["key"], ["bucket"], 20).select("key", *_text("bucket"), "close", "recency")


@query(f"""SELECT event_type, user_id, last(value ORDER BY ts, event_id) AS value, max(event_id) FILTER (WHERE true) AS last_id
FROM (SELECT *, max(event_id) OVER () AS m FROM events WHERE ts < TIMESTAMP '{AS_OF}') GROUP BY 1, 2""")
def asof_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("ts") < _instant()).select("event_type", "user_id", "ts", "event_id", "value")
    return rows.groupBy("event_type", "user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("event_id").alias("last_id"))


@query("SELECT o_custkey, o_orderpriority, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS o_orderkey, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2")
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    return pit.latest_by(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, r.view_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return pit.asof_join(left, right, ["user_id"], "ts", "ts", ["view_id"], ["view_id"]).select("event_id", "user_id", "view_id")


@query("""SELECT o.o_orderkey, o.o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def semi_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(placed, "c_custkey", "left_anti")


@query("""WITH p AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, CAST(p.last_ship AS VARCHAR) AS last_ship FROM p RIGHT JOIN orders o ON p.l_orderkey = o.o_orderkey""")
def right_outer_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_ship"))
    return picked.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "right").select("o_orderkey", *_text("last_ship"))


@query(f"""WITH {bars_sql('day')}, axis AS (SELECT DISTINCT bucket FROM bars), keys AS (SELECT DISTINCT key FROM bars WHERE key <> 'view' UNION SELECT 'unlisted')
SELECT k.key, CAST(a.bucket AS VARCHAR) AS bucket, b.close, row_number() OVER (PARTITION BY k.key ORDER BY a.bucket)::INTEGER AS session_idx
FROM keys k CROSS JOIN axis a LEFT JOIN bars b ON b.key = k.key AND b.bucket = a.bucket""")
def spine_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir, "day")
    keys = b.where("key <> 'view'").select("key").union(spark.createDataFrame([("unlisted",)], "key string"))
    axis = pit.sessions(b, "bucket").select("bucket", "session_idx")
    return pit.spine(keys, axis, b.select("key", "bucket", "close"), "key", "bucket").select("key", *_text("bucket"), "close", "session_idx")


@query(f"""WITH {bars_sql('day')}, s AS (SELECT DISTINCT bucket AS day FROM bars)
SELECT CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY day)::INTEGER AS session_idx, CAST(lag(day) OVER (ORDER BY day) AS VARCHAR) AS previous_session, CAST(lead(day) OVER (ORDER BY day) AS VARCHAR) AS next_session FROM s""")
def session_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = pit.sessions(bars(spark, sf_dir, "day").select(F.col("bucket").alias("day")))
    return axis.select("session_idx", *_text("day", "previous_session", "next_session"))


@query(f"""WITH {bars_sql()}, {ACTIONS_SQL}
SELECT b.key, CAST(b.bucket AS VARCHAR) AS bucket, round(CAST(coalesce(product(a.factor), 1) AS DOUBLE), 6) AS factor
FROM bars b LEFT JOIN actions a ON a.key = b.key AND b.bucket < a.ex_at AND a.ex_at <= TIMESTAMP '{AS_OF}' AND a.knowable_at < TIMESTAMP '{AS_OF}' GROUP BY 1, 2""")
def range_factor_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.adjust import target_factor

    b = target_factor(bars(spark, sf_dir), actions(spark, sf_dir), _instant())
    return b.select("key", *_text("bucket"), F.round(F.col("target").cast("double"), 6).alias("factor"))


@query("""WITH s AS (SELECT s_suppkey, n_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT a.s_suppkey, a.n_name, round(CASE WHEN count(b.s_suppkey) >= 3 THEN a.s_acctbal - median(b.s_acctbal) END, 6) AS relative
FROM s a LEFT JOIN s b ON a.n_name = b.n_name AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey, a.n_name, a.s_acctbal""")
def sector_peer_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey").select("s_suppkey", "n_name", "s_acctbal")
    return ranks.peer_median(s, "n_name", "s_suppkey", "s_acctbal").select("s_suppkey", "n_name", F.round("relative", 6).alias("relative"))


@query(f"""WITH {bars_sql()}, r AS (SELECT key, bucket, close / lag(close) OVER w - 1 AS r, lag(close) OVER w AS p FROM bars WINDOW w AS (PARTITION BY key ORDER BY bucket)),
j AS (SELECT a.key, a.bucket, a.r, b.r AS x, row_number() OVER (PARTITION BY a.key ORDER BY a.bucket DESC) AS n FROM r a JOIN r b ON a.bucket = b.bucket AND b.key = 'view' AND b.p > 0 WHERE a.p > 0)
SELECT key, round(CASE WHEN count(*) >= 60 THEN regr_slope(r, x) END, 6) AS beta, CASE WHEN count(*) < 60 THEN 'INSUFFICIENT_HISTORY' END AS beta_reason FROM j WHERE n <= 60 GROUP BY key""")
def beta_common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return B.beta(b, b.where("key = 'view'")).select("key", *_rounded("beta"))


_FEATURE_SQL = f"""WITH {bars_sql()}, f AS (SELECT *, row_number() OVER w AS n,
 lag(close, 20) OVER w AS c20, avg(close) OVER w20 AS m20, max(high) OVER w20 AS h20, min(low) OVER w20 AS l20, max(high) OVER p20 AS ph, min(low) OVER p20 AS pl,
 avg(volume) OVER w20 AS v20, avg(volume) OVER p20 AS pv, avg(close * volume) OVER w20 AS t20, lag(close, 5) OVER w AS c5,
 avg(close) OVER w50 AS m50, avg(close) OVER w200 AS m200 FROM bars
 WINDOW w AS (PARTITION BY key ORDER BY bucket), w20 AS (PARTITION BY key ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
 p20 AS (PARTITION BY key ORDER BY bucket ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
 w50 AS (PARTITION BY key ORDER BY bucket ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), w200 AS (PARTITION BY key ORDER BY bucket ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""


@query(_FEATURE_SQL + """ SELECT key, CAST(bucket AS VARCHAR) AS bucket, round(CASE WHEN n > 20 AND c20 > 0 THEN close / c20 - 1 END, 6) AS ret_20d,
 CASE WHEN n <= 20 THEN 'INSUFFICIENT_HISTORY' WHEN c20 <= 0 THEN 'DIVISION_UNDEFINED' END AS ret_20d_reason,
 round(CASE WHEN n >= 20 THEN m20 END, 6) AS sma_20, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' END AS sma_20_reason,
 round(CASE WHEN n >= 20 THEN close / m20 - 1 END, 6) AS close_to_sma_20, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' END AS close_to_sma_20_reason,
 round(CASE WHEN n >= 20 THEN close / h20 - 1 END, 6) AS dist_high_20, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' END AS dist_high_20_reason,
 round(CASE WHEN n >= 20 THEN close / l20 - 1 END, 6) AS dist_low_20, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' END AS dist_low_20_reason FROM f""")
def ret_sma_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["ret_20d", "sma_20", "close_to_sma_20", "dist_high_20", "dist_low_20"]
    f = B.features(bars(spark, sf_dir), names, plain=True)
    return f.select("key", *_text("bucket"), *[c for n in names for c in (sql_round(F.col(f"{n}.value")).alias(n), F.col(f"{n}.reason").alias(f"{n}_reason"))])


@query(_FEATURE_SQL + """ SELECT key, CAST(bucket AS VARCHAR) AS bucket, CASE WHEN n > 20 THEN CAST(close > ph AS INTEGER)::DOUBLE END AS breakout_20, CASE WHEN n <= 20 THEN 'INSUFFICIENT_HISTORY' END AS breakout_20_reason,
 CASE WHEN n > 20 THEN CAST(close < pl AS INTEGER)::DOUBLE END AS breakdown_20, CASE WHEN n <= 20 THEN 'INSUFFICIENT_HISTORY' END AS breakdown_20_reason,
 round(CASE WHEN n >= 20 THEN v20 END, 6) AS avg_volume_20, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' END AS avg_volume_20_reason,
 round(CASE WHEN n > 20 THEN volume / pv END, 6) AS volume_spike_20, CASE WHEN n <= 20 THEN 'INSUFFICIENT_HISTORY' END AS volume_spike_20_reason,
 round(CASE WHEN n >= 20 THEN t20 END, 6) AS turnover_20, CASE WHEN n < 20 THEN 'INSUFFICIENT_HISTORY' END AS turnover_20_reason FROM f""")
def breakout_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["breakout_20", "breakdown_20", "avg_volume_20", "volume_spike_20", "turnover_20"]
    f = B.features(bars(spark, sf_dir), names)
    return f.select("key", *_text("bucket"), *[c for n in names for c in _rounded(n)])


@query(_FEATURE_SQL + """ SELECT key, CAST(bucket AS VARCHAR) AS bucket, CASE WHEN n >= 200 THEN CASE WHEN close > m50 AND m50 > m200 THEN 1.0 WHEN close < m50 AND m50 < m200 THEN -1.0 ELSE 0.0 END END::DOUBLE AS market_regime_trend,
 CASE WHEN n < 200 THEN 'INSUFFICIENT_HISTORY' END AS market_regime_trend_reason, round(close - c5, 6) AS india_vix_change_5d, CASE WHEN n <= 5 THEN 'INSUFFICIENT_HISTORY' END AS india_vix_change_5d_reason FROM f""")
def regime_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["market_regime_trend", "india_vix_change_5d"]
    f = B.features(bars(spark, sf_dir), names)
    return f.select("key", *_text("bucket"), *[c for n in names for c in _rounded(n)])


@query(f"""WITH {bars_sql()}, r AS (SELECT *, row_number() OVER w AS n, ln(close / lag(close) OVER w) AS s FROM bars WINDOW w AS (PARTITION BY key ORDER BY bucket))
SELECT key, CAST(bucket AS VARCHAR) AS bucket, round(CASE WHEN n > 20 THEN stddev_samp(s) OVER (PARTITION BY key ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) END, 6) AS volatility_20,
 CASE WHEN n <= 20 THEN 'INSUFFICIENT_HISTORY' END AS volatility_20_reason FROM r""")
def volatility_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_volatility(bars(spark, sf_dir)).select("key", *_text("bucket"), *_rounded("volatility_20"))


@query(f"""WITH {bars_sql()}, w AS (SELECT key, bucket, close, row_number() OVER (PARTITION BY key ORDER BY bucket) AS n, list(close) OVER (PARTITION BY key ORDER BY bucket ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS c FROM bars)
SELECT key, CAST(bucket AS VARCHAR) AS bucket, round(CASE WHEN n >= 252 THEN len(list_filter(c, lambda x: x <= close)) / 252.0 END, 6) AS india_vix_pctile_252, CASE WHEN n < 252 THEN 'INSUFFICIENT_HISTORY' END AS india_vix_pctile_252_reason FROM w""")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.features(bars(spark, sf_dir), ["india_vix_pctile_252"])
    return f.select("key", *_text("bucket"), *_rounded("india_vix_pctile_252"))


_FOLD = f"WITH {bars_sql()}, h AS (SELECT key, list(close ORDER BY bucket) AS c, list(high ORDER BY bucket) AS hi, list(low ORDER BY bucket) AS lo FROM bars GROUP BY key)"
_EMA = "list_reduce(c[{n1}:], lambda e, x: (2.0 / ({n} + 1)) * x + (1 - 2.0 / ({n} + 1)) * e, list_sum(c[1:{n}]) / {n})"


@query(_FOLD + f" SELECT key, round(CASE WHEN len(c) >= 12 THEN {_EMA.format(n=12, n1=13)} END, 6) AS ema_12, round(CASE WHEN len(c) >= 26 THEN {_EMA.format(n=26, n1=27)} END, 6) AS ema_26 FROM h")
def ema_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest_indicators(bars(spark, sf_dir)).select("key", *[F.round(F.col(f"{n}.value"), 6).alias(n) for n in ("ema_12", "ema_26")])


@query(_FOLD + """, d AS (SELECT key, list_transform(range(2, len(c) + 1), lambda i: c[i] - c[i - 1]) AS d FROM h), s AS (
 SELECT key, len(d) AS n, list_reduce(d[15:], lambda e, x: (e * 13 + greatest(x, 0)) / 14, list_sum(list_transform(d[1:14], lambda x: greatest(x, 0))) / 14) AS g,
  list_reduce(d[15:], lambda e, x: (e * 13 + greatest(-x, 0)) / 14, list_sum(list_transform(d[1:14], lambda x: greatest(-x, 0))) / 14) AS l FROM d)
SELECT key, round(CASE WHEN n >= 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 6) AS rsi_14 FROM s""")
def rsi_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest_indicators(bars(spark, sf_dir)).select("key", F.round("rsi_14.value", 6).alias("rsi_14"))


@query(_FOLD + """, t AS (SELECT key, c, list_transform(range(2, len(c) + 1), lambda i: greatest(hi[i] - lo[i], abs(hi[i] - c[i - 1]), abs(lo[i] - c[i - 1]))) AS t FROM h)
SELECT key, round(list_reduce(t[15:], lambda e, x: (e * 13 + x) / 14, list_sum(t[1:14]) / 14), 6) AS atr_14, round(list_reduce(t[15:], lambda e, x: (e * 13 + x) / 14, list_sum(t[1:14]) / 14) / c[len(c)], 6) AS atr_pct_14 FROM t WHERE len(c) >= 15""")
def atr_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest_indicators(bars(spark, sf_dir)).where("atr_14.value IS NOT NULL").select("key", *[F.round(F.col(f"{n}.value"), 6).alias(n) for n in ("atr_14", "atr_pct_14")])


@query(f"""WITH RECURSIVE {bars_sql()}, o AS (SELECT key, close, row_number() OVER (PARTITION BY key ORDER BY bucket) AS i FROM bars),
seed AS (SELECT key, sum(close) FILTER (WHERE i <= 12) / 12 AS f, sum(close) FILTER (WHERE i <= 26) / 26 AS s FROM o GROUP BY key),
e AS (SELECT key, 12::BIGINT AS i, f AS v FROM seed UNION ALL SELECT e.key, e.i + 1, (2.0 / 13) * o.close + (1 - 2.0 / 13) * e.v FROM e JOIN o ON o.key = e.key AND o.i = e.i + 1),
g AS (SELECT key, 26::BIGINT AS i, s AS v FROM seed UNION ALL SELECT g.key, g.i + 1, (2.0 / 27) * o.close + (1 - 2.0 / 27) * g.v FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1),
line AS (SELECT e.key, e.i, e.v - g.v AS v FROM e JOIN g ON e.key = g.key AND e.i = g.i),
t AS (SELECT key, 34::BIGINT AS i, avg(v) AS v FROM line WHERE i <= 34 GROUP BY key UNION ALL SELECT t.key, t.i + 1, 0.2 * l.v + 0.8 * t.v FROM t JOIN line l ON l.key = t.key AND l.i = t.i + 1)
SELECT l.key, round(last(l.v ORDER BY l.i), 6) AS macd_line, round(last(t.v ORDER BY t.i), 6) AS macd_trigger, round(last(l.v ORDER BY l.i) - last(t.v ORDER BY t.i), 6) AS macd_histogram FROM line l JOIN t ON t.key = l.key AND t.i = l.i GROUP BY l.key""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("macd_line", "macd_trigger", "macd_histogram")
    return I.latest_indicators(bars(spark, sf_dir)).select("key", *[F.round(F.col(f"{n}.value"), 6).alias(n) for n in names])


@query()
def indicator_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.indicator_series(bars(spark, sf_dir))


@query("""SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal, -3)) + (count(*) OVER (PARTITION BY s_nationkey, round(s_acctbal, -3)) - 1) / 2.0::DOUBLE AS avg_rank FROM supplier""")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("v", F.round("s_acctbal", -3))
    return s.select("s_suppkey", ranks.average_rank("v", ["s_nationkey"]).cast("double").alias("avg_rank"))


_UNIT = "CASE WHEN count(*) OVER (PARTITION BY {by}) < 2 THEN 0 ELSE (rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0 - 1) / (count(*) OVER (PARTITION BY {by}) - 1) - 0.5 END"


@query(f"SELECT p_partkey, round({_UNIT.format(by='p_brand', v='p_retailprice')}, 6) AS unit_rank, CAST(floor(least(({_UNIT.format(by='p_brand', v='p_retailprice')} + 0.5) * 10, 10 - 1e-9)) AS INTEGER) AS decile FROM part")
def unit_rank_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(ranks.unit_rank("p_retailprice", ["p_brand"]), 6).alias("unit_rank"), ranks.bins("p_retailprice", ["p_brand"]).alias("decile"))


@query(f"""WITH {MONTHLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turnover DESC, key) AS place FROM monthly)
SELECT session, key, turnover, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20""")
def top_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.top_n(monthly(spark, sf_dir), ["session"], [F.desc("turnover"), F.asc("key")], 20).select("session", "key", "turnover", "place")


@query(f"""WITH {MONTHLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, key) AS place, count(*) OVER (PARTITION BY session) AS n FROM monthly)
SELECT session, key, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= floor(n * 0.2)""")
def top_share_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.top_share(monthly(spark, sf_dir), ["session"], [F.desc("score"), F.asc("key")], 0.2).select("session", "key", "score", "place")


_CELLS = f"""WITH {MONTHLY_SQL}, c AS (SELECT *, CAST(floor(least(({_UNIT.format(by='session', v='turnover')} + 0.5) * 10, 10 - 1e-9)) AS INTEGER) AS cell_t,
 CAST(floor(least(({_UNIT.format(by='session', v='spread')} + 0.5) * 3, 3 - 1e-9)) AS INTEGER) AS cell_s, key % 5 = 0 AS picked FROM monthly),
pool AS (SELECT session, cell_t, cell_s, avg(score) AS m, count(*) AS n FROM c WHERE NOT picked GROUP BY 1, 2, 3)"""


@query(_CELLS + " SELECT c.session, c.key, round(c.score - p.m, 9) AS excess, p.n AS pool_n FROM c LEFT JOIN pool p ON p.session = c.session AND p.cell_t = c.cell_t AND p.cell_s = c.cell_s WHERE c.picked")
def matched_cells_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monthly(spark, sf_dir)
    m = m.withColumns({"cell_t": ranks.bins("turnover", ["session"]), "cell_s": ranks.bins("spread", ["session"], 3), "picked": F.col("key") % 5 == 0})
    return ranks.matched_excess(m, ["session"], ["cell_t", "cell_s"], "score", "picked").select("session", "key", F.round("excess", 9).alias("excess"), "pool_n")


@query("""WITH d AS (SELECT o_orderpriority AS arm, CAST(o_orderdate AS DATE) AS day, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END), 2) AS net FROM orders GROUP BY 1, 2),
e AS (SELECT *, sum(net) OVER (PARTITION BY arm ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM d)
SELECT arm, CAST(day AS VARCHAR) AS day, round(equity, 2) AS equity, round(greatest(max(equity) OVER (PARTITION BY arm ORDER BY day ROWS UNBOUNDED PRECEDING), 0) - equity, 2) AS drawdown FROM e""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    d = o.groupBy(F.col("o_orderpriority").alias("arm"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum(signed), 2).alias("net"))
    return ranks.drawdown(d, ["arm"], "day", "net").select("arm", *_text("day"), F.round("equity", 2).alias("equity"), F.round("drawdown", 2).alias("drawdown"))


@query("""SELECT c_mktsegment, c_custkey, CASE WHEN r <= 100 THEN 'LARGE' WHEN r <= 250 THEN 'MID' ELSE 'SMALL' END AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)""")
def cap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return c.select("c_mktsegment", "c_custkey", ranks.cap_bucket(place).alias("bucket"))


@query("""SELECT user_id, max(value) FILTER (WHERE event_type = 'view') AS "view", max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'purchase') AS purchase, max(value) FILTER (WHERE event_type = 'signup') AS signup, max(value) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1""")
def pivot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase", "signup", "error"]).agg(F.max("value"))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS deep, count(*) FILTER (WHERE l_tax = 0) AS untaxed, count(*) FILTER (WHERE l_quantity <= 0) AS bad_quantity, count(DISTINCT l_suppkey) AS suppliers, bool_or(l_quantity > 49) AS any_large FROM lineitem GROUP BY 1""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("deep"), F.count_if(F.col("l_tax") == 0).alias("untaxed"),
        F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.count_distinct("l_suppkey").alias("suppliers"), F.bool_or(F.col("l_quantity") > 49).alias("any_large"),
    )


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(quantile_cont(o_totalprice, 0.5), 4) AS p50 FROM orders GROUP BY 1")
def percentile_cont_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("o_totalprice", q), 4)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(p(0.99).alias("p99"), p(0.5).alias("p50"))


@query("SELECT p_brand, list_sort(list(p_retailprice))[len(list(p_retailprice)) // 2 + 1] AS upper_median, list_sort(list(p_size))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS INTEGER) + 1] AS p90_size FROM part GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    prices = orderstats.order_statistics(part, ["p_brand"], "p_retailprice", {"upper_median": orderstats.upper_median})
    sizes = orderstats.order_statistics(part, ["p_brand"], "p_size", {"p90_size": orderstats.nearest_rank(0.9)})
    return prices.drop("n").join(sizes.drop("n"), "p_brand")


@query("""WITH r AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), c AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM r),
a AS (SELECT len(list_filter(q, lambda x: x < v)) AS b, count(*) AS n FROM r, e GROUP BY 1), d AS (SELECT len(list_filter(q, lambda x: x < v)) AS b, count(*) AS n FROM c, e GROUP BY 1),
s AS (SELECT greatest(coalesce(a.n, 0) / sum(a.n) OVER (), 1e-6) AS p, greatest(coalesce(d.n, 0) / sum(d.n) OVER (), 1e-6) AS q FROM a FULL JOIN d ON a.b = d.b)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s""")
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    got = ranks.psi(line.where(F.col("l_shipdate") < cut), line.where(F.col("l_shipdate") >= cut), "l_extendedprice")
    return got.select(F.round("psi", 6).alias("psi"))


_STATES = f"""WITH {bars_sql()}, s AS (SELECT key, bucket, CASE WHEN volume >= 4 THEN 'BUSY' WHEN volume >= 2 THEN 'NORMAL' ELSE 'THIN' END AS state FROM bars),
c AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY key ORDER BY bucket) THEN 1 ELSE 0 END AS n FROM s), r AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS run FROM c)"""


@query(_STATES + " SELECT key, state, CAST(min(bucket) AS VARCHAR) AS first, CAST(max(bucket) AS VARCHAR) AS last, count(*) AS length FROM r GROUP BY key, run, state")
def coverage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("state", F.when(F.col("volume") >= 4, "BUSY").when(F.col("volume") >= 2, "NORMAL").otherwise("THIN"))
    return pit.islands(b, ["key"], "bucket", "state").select("key", "state", *_text("first", "last"), "length")


@query("""SELECT o_orderstatus, md5(string_agg(md5(o_orderkey || '|' || o_custkey || '|' || o_orderpriority), '' ORDER BY o_orderkey)) AS fingerprint, count(*) AS rows FROM orders GROUP BY 1""")
def ordered_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.fingerprint(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey"], ["o_orderkey", "o_custkey", "o_orderpriority"])


@query(f"""WITH {bars_sql('day')}, s AS (SELECT bucket, coalesce(sum(close * volume) FILTER (WHERE key = 'purchase'), NULL) AS buy, sum(close * volume) FILTER (WHERE key = 'signup') AS sell FROM bars GROUP BY 1),
n AS (SELECT *, buy - sell AS net, row_number() OVER (ORDER BY bucket) AS i FROM s WHERE buy IS NOT NULL AND sell IS NOT NULL)
SELECT CAST(bucket AS VARCHAR) AS bucket, round(net, 4) AS net_1d, round(CASE WHEN i >= 5 THEN sum(net) OVER (ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 4) AS net_5d FROM n""")
def net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("close") * F.col("volume")
    days = bars(spark, sf_dir, "day").groupBy("bucket").agg(F.sum(F.when(F.col("key") == "purchase", amount)).alias("buy"), F.sum(F.when(F.col("key") == "signup", amount)).alias("sell"))
    net = days.where("buy IS NOT NULL AND sell IS NOT NULL").withColumn("net", F.col("buy") - F.col("sell"))
    w = Window.orderBy("bucket")  # one row a day
    five = F.when(F.row_number().over(w) >= 5, F.sum("net").over(w.rowsBetween(-4, 0)))
    return net.select(*_text("bucket"), F.round("net", 4).alias("net_1d"), F.round(five, 4).alias("net_5d"))


@query("SELECT event_id, CAST(printf('%.11e', value * 1.000000123456789 / 7) AS DOUBLE) AS v FROM events")
def significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", digits12(F.col("value") * 1.000000123456789 / 7).alias("v"))


@query(f"""WITH {KNOWN_SQL}, a AS (SELECT key, bucket, close FROM known WHERE knowable_at < TIMESTAMP '{AS_OF}'), n AS (SELECT key, bucket, CASE WHEN volume = 3 THEN close + 1 ELSE close END AS close FROM known)
SELECT n.key, CAST(n.bucket AS VARCHAR) AS bucket, CASE WHEN a.key IS NULL THEN 'append' ELSE 'conflict' END AS outcome FROM n LEFT JOIN a ON a.key = n.key AND a.bucket = n.bucket WHERE a.key IS NULL OR a.close IS DISTINCT FROM n.close""")
def append_only_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_bars(spark, sf_dir)
    new = known.select("key", "bucket", F.when(F.col("volume") == 3, F.col("close") + 1).otherwise(F.col("close")).alias("close"))
    absent, conflict = pit.insert_if_absent(pit.as_of(known, _instant()).select("key", "bucket", "close"), new, ["key", "bucket"], ["close"])
    out = lambda df, what: df.select("key", *_text("bucket"), F.lit(what).alias("outcome"))
    return out(absent, "append").union(out(conflict, "conflict"))


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'NEW' WHEN b.p_partkey IS NULL THEN 'GONE' WHEN a.p_size IS NOT DISTINCT FROM b.p_size THEN 'SEEN' ELSE 'CHANGED' END AS state
FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0) b ON a.p_partkey = b.p_partkey""")
def scd2_master_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    new = p.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return pit.master_diff(p.where("p_partkey % 7 <> 0"), new, "p_partkey", ["p_size"])


@query("""SELECT c.c_custkey, o.o_orderkey, round(o.o_totalprice, 2) AS o_totalprice FROM customer c LEFT JOIN LATERAL (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 10 ORDER BY o.o_orderdate, o.o_orderkey LIMIT 1) o ON true""")
def lateral_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    on = (F.col("l.c_custkey") == F.col("r.o_custkey")) & (F.col("r.o_totalprice") > F.col("l.c_acctbal") * 10)
    got = pit.first_match(c, o, on, ["c_custkey"], [F.col("r.o_orderdate"), F.col("r.o_orderkey")], ["o_orderkey", "o_totalprice"])
    return got.select("c_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
