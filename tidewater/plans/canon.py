"""Queries over the canonical layer: universe, knowability, coverage, gates, source quality, links and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canon as C
from .derive import table
from .market import _text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_INSTRUMENT = """concat('K', p_partkey) AS key, CASE p_partkey % 10 WHEN 0 THEN 'NSE_INDEX' WHEN 1 THEN 'GLOBAL_INDEX' WHEN 2 THEN 'BSE_EQ' ELSE 'NSE_EQ' END AS segment, CASE p_size % 4 WHEN 0 THEN 'EQ' WHEN 1 THEN 'be' WHEN 2 THEN 'N1' END AS series,
CASE WHEN p_partkey % 7 = 0 THEN 'INE002A01019' WHEN p_partkey % 11 <> 0 THEN 'INE002A01018' END AS isin, CASE WHEN p_partkey % 13 <> 0 THEN concat('S', p_partkey) END AS symbol, CASE WHEN p_partkey % 19 = 0 THEN 'BSE' ELSE 'NSE' END AS exchange"""
_SERIES, _INDEXES = ("BE", "EQ"), ("K10", "K30", "K110")


def _instruments(spark, sf_dir):
    i = spark.sql(f"SELECT {_INSTRUMENT} FROM {{p}}", p=table(spark, sf_dir, "part"))
    return i.withColumn("d", C.universe_decision(*[F.col(c) for c in ("segment", "series", "isin", "symbol", "key")], _SERIES, _INDEXES)).select("*", "d.*").drop("d")


_DECIDED = f"""i AS (SELECT {_INSTRUMENT} FROM part), decided AS (SELECT *, CASE WHEN segment = 'NSE_EQ' THEN CASE WHEN series IS NULL OR upper(series) NOT IN ('BE', 'EQ') THEN 'SERIES' WHEN isin IS NULL OR isin = 'INE002A01019' OR symbol IS NULL THEN 'MALFORMED' ELSE 'EQUITY' END
 WHEN segment = 'NSE_INDEX' THEN CASE WHEN key IN ('K10', 'K30', 'K110') THEN 'APPROVED_INDEX' ELSE 'INDEX_NOT_APPROVED' END WHEN segment = 'GLOBAL_INDEX' THEN 'GLOBAL' ELSE 'SEGMENT' END AS reason FROM i), instruments AS (SELECT *, reason IN ('EQUITY', 'APPROVED_INDEX') AS included FROM decided)"""


@query(f"""WITH {_DECIDED} SELECT key, included, reason, CASE WHEN segment <> 'NSE_EQ' THEN 'excluded:segment=' || segment WHEN series IS NULL THEN 'excluded:series=<none>' WHEN upper(series) NOT IN ('BE', 'EQ') THEN 'excluded:series=' || series ELSE 'selected' END AS preopen,
array_to_string(list_filter([CASE WHEN symbol IS NULL THEN 'symbol' END, CASE WHEN segment = 'NSE_EQ' AND (isin IS NULL OR isin = 'INE002A01019') THEN 'isin' END], lambda x: x IS NOT NULL), ',') AS faults FROM instruments""")
def universe_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _instruments(spark, sf_dir)
    return i.select("key", "included", "reason", C.preopen_rule(F.col("segment"), F.col("series"), _SERIES).alias("preopen"), F.array_join(C.identifier_faults(F.col("segment"), F.col("symbol"), F.col("isin")), ",").alias("faults"))


@query("""WITH k AS (SELECT trim(CASE WHEN o_custkey % 9 = 0 THEN ' ' ELSE ' NSE_EQ|' || o_custkey END) AS key FROM orders), d AS (SELECT key, count(*) AS requests, row_number() OVER (ORDER BY key) AS place FROM k WHERE key <> '' GROUP BY 1)
SELECT key, requests, CAST(place AS INTEGER) AS place, CASE WHEN place <= 600 THEN CAST((place - 1) // 200 AS INTEGER) END AS shard FROM d""")
def subscription_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" NSE_EQ|"), F.col("o_custkey").cast("string"))).alias("key"))
    return C.subscription(k, 200, 3)


_TIMES = """WITH e AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN '1d' WHEN 1 THEN '1m' WHEN 2 THEN '15m' ELSE '1h' END AS tf, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, CASE WHEN event_id % 5 <> 0 THEN 33300 END AS os, CASE WHEN event_id % 5 <> 0 THEN 55800 END AS cs, CASE WHEN event_id % 3 <> 0 THEN 32400 END AS ps FROM events),
x AS (SELECT *, day - INTERVAL 330 MINUTE AS m, CASE tf WHEN '1m' THEN 60 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 END AS w FROM e)"""


@query(_TIMES + """ SELECT event_id, strftime(CASE WHEN tf = '1d' THEN m + to_seconds(os) ELSE ts END, '%Y-%m-%d %H:%M:%S') AS event_start, strftime(CASE WHEN tf = '1d' THEN m + to_seconds(cs) ELSE least(date_trunc('second', ts) + to_seconds(w), m + to_seconds(cs)) END, '%Y-%m-%d %H:%M:%S') AS event_end,
 strftime(CASE WHEN event_id % 2 = 0 THEN m + to_seconds(coalesce(ps, os) - 1) ELSE m + to_seconds(ps + 480) END, '%Y-%m-%d %H:%M:%S') AS snapshot_at, strftime(least(m + to_seconds(86399), ts + to_hours(CAST(event_id % 30 AS INTEGER))), '%Y-%m-%d %H:%M:%S') AS known_on_date FROM x""")
def market_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "element_at(array('1d', '1m', '15m', '1h'), CAST(event_id % 4 AS INT) + 1) AS tf", "CAST(ts AS DATE) AS day", "CASE WHEN event_id % 5 <> 0 THEN 33300 END AS os", "CASE WHEN event_id % 5 <> 0 THEN 55800 END AS cs", "CASE WHEN event_id % 3 <> 0 THEN 32400 END AS ps")
    w = C.event_window(F.col("tf"), F.col("day"), F.col("ts"), F.col("os"), F.col("cs"))
    fetched = F.expr("ts + make_dt_interval(0, CAST(event_id % 30 AS INT), 0, 0)")
    kind = F.when(F.col("event_id") % 2 == 0, "PRE_SESSION").otherwise("PRE_OPEN")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", text(w["event_start"]).alias("event_start"), text(w["event_end"]).alias("event_end"), text(C.snapshot_instant(F.col("day"), kind, F.col("ps"), F.col("os"))).alias("snapshot_at"), text(C.knowable_on_date(F.col("day"), fetched)).alias("known_on_date"))


@query("""WITH r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS e FROM orders), c AS (SELECT *, CAST(unnest(generate_series(CAST(date_trunc('quarter', s) AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 3 MONTH)) AS DATE) AS w FROM r)
SELECT id, CAST(greatest(w, s) AS VARCHAR) AS from_date, CAST(least(CAST(w + INTERVAL 3 MONTH AS DATE) - 1, e) AS VARCHAR) AS to_date FROM c""")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderdate AS DATE) AS start", "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 400 AS INT)) AS end")
    return C.request_windows(r, 3).select("id", *_text("from_date", "to_date"))


#: Sessions are the days of the orders of 1996; bars the lines shipped then, by supplier.
_SESSIONS = """s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'), k AS (SELECT s_suppkey AS key FROM supplier),
b AS (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS day, count(*) FILTER (WHERE l_returnflag <> 'R') AS bars, count(*) FILTER (WHERE l_returnflag = 'R') AS quarantined FROM lineitem GROUP BY 1, 2),
w AS (SELECT s_suppkey AS key, DATE '1996-01-01' + CAST(n * 10 AS INTEGER) AS f, DATE '1996-01-01' + CAST(n * 10 + 12 AS INTEGER) AS t, CASE (s_suppkey + n) % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'ABORTED' END AS status, n AS no FROM supplier, (SELECT unnest(range(0, 8)) AS n)),
st AS (SELECT k.key, s.day, coalesce(b.bars, 0) AS bars, coalesce(b.quarantined, 0) AS quarantined, CASE WHEN b.bars > 0 THEN 'DATA' WHEN b.quarantined > 0 THEN 'QUARANTINED' WHEN EXISTS (SELECT 1 FROM w WHERE w.key = k.key AND s.day BETWEEN f AND t AND status = 'COMPLETE') THEN 'EMPTY'
 WHEN (SELECT arg_max(status, no) FROM w WHERE w.key = k.key AND s.day BETWEEN f AND t AND status IN ('FAILED', 'ABORTED')) = 'FAILED' THEN 'VENDOR_ERROR' WHEN k.key % 2 = 0 AND s.day BETWEEN DATE '1996-01-10' AND DATE '1996-03-10' THEN 'MISSING' ELSE 'PENDING_BACKFILL' END AS state FROM k CROSS JOIN s LEFT JOIN b ON b.key = k.key AND b.day = s.day)"""


def _states(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate >= '1996-01-01' AND o_orderdate < '1996-04-01'").select(F.to_date("o_orderdate").alias("day")).distinct()
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("day"), "l_returnflag")
    windows = keys.selectExpr("key", "explode(sequence(0, 7)) AS started_at").selectExpr("key", "date_add(DATE'1996-01-01', started_at * 10) AS from_date", "date_add(DATE'1996-01-01', started_at * 10 + 12) AS to_date", "element_at(array('COMPLETE', 'FAILED', 'ABORTED', NULL), CAST((key + started_at) % 4 AS INT) + 1) AS status", "started_at").where("status IS NOT NULL")
    checkpoints = keys.where("key % 2 = 0").selectExpr("key", "DATE'1996-01-10' AS from_date", "DATE'1996-03-10' AS to_date")
    return C.session_states(keys.join(F.broadcast(o)), line.where("l_returnflag <> 'R'"), line.where("l_returnflag = 'R'"), windows, checkpoints)


@query(f"WITH {_SESSIONS} SELECT key, CAST(day AS VARCHAR) AS day, bars, quarantined, state FROM st")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("key", *_text("day"), "bars", "quarantined", "state")


@query(f"""WITH {_SESSIONS}, g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) - row_number() OVER (PARTITION BY key, state ORDER BY day) AS g FROM st)
SELECT key, state, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS length FROM g GROUP BY key, state, g""")
def coverage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(_states(spark, sf_dir)).select("key", "state", *_text("first", "last"), "length")


_BARS = f"""WITH {_DECIDED}, c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 3 <> 0), cal AS (SELECT day, dayofweek(day) BETWEEN 1 AND 5 AS t FROM c),
b AS (SELECT l_orderkey, l_linenumber, 'K' || l_partkey AS key, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""


@query(_BARS + """ SELECT b.l_orderkey, b.l_linenumber, b.key, CASE WHEN NOT coalesce(i.included, false) THEN 'INSTRUMENT' WHEN cal.t IS NULL THEN 'NO_CALENDAR' WHEN NOT cal.t THEN 'NOT_TRADING' END AS why FROM b LEFT JOIN instruments i ON i.key = b.key LEFT JOIN cal ON cal.day = b.day""")
def canonical_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("is_trading", F.dayofweek("day").between(2, 6))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("key"), F.to_date("l_shipdate").alias("day"))
    kept, out = C.canonical_bars(b, _instruments(spark, sf_dir), days)
    return kept.withColumn("why", F.lit(None).cast("string")).unionByName(out).drop("day")


@query(f"""WITH {_DECIDED}, {_SESSIONS}, r AS (SELECT l_orderkey, l_linenumber, 'K' || l_partkey AS key, CASE l_linenumber % 4 WHEN 0 THEN '1w' WHEN 1 THEN '1d' ELSE '1h' END AS tf, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS open, CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice / 2 ELSE l_extendedprice * 2 END AS high, l_extendedprice / 2 AS low,
 CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE l_extendedprice END AS close, CASE WHEN l_orderkey % 37 = 0 THEN -1 ELSE l_quantity END AS volume, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_orderkey % 40 AS INTEGER)) AS fetched, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_suppkey % 40 AS INTEGER)) AS known FROM lineitem),
q AS (SELECT r.* FROM r SEMI JOIN (SELECT key FROM instruments WHERE included) z ON z.key = r.key), cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, dayofweek(CAST(o_orderdate AS DATE)) BETWEEN 1 AND 5 AS t FROM orders WHERE o_orderkey % 3 <> 0)
SELECT gate, n AS violations, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
SELECT 'duplicate_bars' AS gate, count(*) AS n FROM (SELECT 1 FROM q GROUP BY key, tf, day HAVING count(*) > 1) UNION ALL SELECT 'invalid_ohlc', count(*) FROM q WHERE NOT (high >= greatest(open, low, close) AND low <= least(open, close)) OR least(open, high, low, close) <= 0 UNION ALL SELECT 'negative_volume', count(*) FROM q WHERE volume < 0
UNION ALL SELECT 'null_required_bar_fields', count(*) FROM q WHERE close IS NULL UNION ALL SELECT 'knowable_after_fetched', (SELECT count(*) FROM r WHERE known > fetched) + (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 3) UNION ALL SELECT 'bar_knowable_before_event_end', count(*) FROM q WHERE known < CAST(day AS TIMESTAMP) + INTERVAL 10 HOUR
UNION ALL SELECT 'daily_bar_fetched_same_session', count(*) FROM q WHERE tf = '1d' AND CAST(fetched AS DATE) <= day UNION ALL SELECT 'non_session_bars_exposed', count(*) FROM q WHERE NOT EXISTS (SELECT 1 FROM cal WHERE cal.day = q.day AND t) UNION ALL SELECT 'orphan_instruments', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM instruments i WHERE i.key = r.key)
UNION ALL SELECT 'invalid_exchange', count(*) FROM instruments WHERE included AND exchange <> 'NSE' UNION ALL SELECT 'invalid_timeframe', count(DISTINCT tf) FROM q WHERE tf = '1w' UNION ALL SELECT 'missing_identifiers', count(*) FROM instruments WHERE included AND symbol IS NULL UNION ALL SELECT 'unexpected_gaps', count(*) FROM st WHERE state = 'MISSING'
UNION ALL SELECT 'duplicate_corporate_actions', count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1) UNION ALL SELECT 'duplicate_news_mappings', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1) UNION ALL SELECT 'invalid_fundamentals', count(*) FROM supplier WHERE s_suppkey % 6 IN (0, 1)
UNION ALL SELECT 'calendar_gaps_in_depth', count(*) FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS day) d WHERE NOT EXISTS (SELECT 1 FROM cal WHERE cal.day = d.day) UNION ALL SELECT 'coverage_contradicts_bars', count(*) FROM st WHERE (state = 'DATA') <> (bars > 0))""")
def canonical_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_orderkey"), F.col("l_extendedprice")
    hours = lambda c: F.expr(f"CAST(l_shipdate AS TIMESTAMP) + make_dt_interval(0, CAST({c} % 40 AS INT), 0, 0)")
    line = table(spark, sf_dir, "lineitem")
    b = line.select(
        F.concat(F.lit("K"), F.col("l_partkey").cast("string")).alias("key"), F.expr("element_at(array('1w', '1d', '1h', '1h'), CAST(l_linenumber % 4 AS INT) + 1)").alias("timeframe"), F.to_date("l_shipdate").alias("day"), F.to_date("l_shipdate").alias("start"), p.alias("open"), F.when(n % 50 == 0, p / 2).otherwise(p * 2).alias("high"),
        (p / 2).alias("low"), F.when(n % 41 != 0, p).alias("close"), F.when(n % 37 == 0, -1).otherwise(F.col("l_quantity")).alias("volume"), hours("l_orderkey").alias("fetched_at"), hours("l_suppkey").alias("knowable_at"), F.expr("CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL '10' HOUR").alias("event_end"), F.lit("x").alias("payload_sha256"),
    )
    o = table(spark, sf_dir, "orders")
    cal = o.where("o_orderkey % 3 <> 0").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("is_trading", F.dayofweek("day").between(2, 6))
    dated = {"news": o.selectExpr("CAST(o_orderdate AS TIMESTAMP) AS fetched_at", "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END, 0, 0) AS knowable_at")}
    actions = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("isin"), F.col("c_mktsegment").alias("content_sha256"))
    news = line.select(F.col("l_orderkey").alias("news_id"), F.col("l_suppkey").alias("key"))
    k = F.col("s_suppkey") % 6
    statements = table(spark, sf_dir, "supplier").select(F.when(k == 0, "null").otherwise("{}").alias("payload"), F.when(k != 1, "income").alias("statement_type"))
    return C.gates(b, _instruments(spark, sf_dir), cal, dated, actions, news, statements, _states(spark, sf_dir), "1995-01-01", "1995-12-31")


@query("""WITH r AS (SELECT o_orderpriority AS stream, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) AS INTEGER) AS run_no, n AS rows FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2)),
x AS (SELECT *, avg(rows) OVER (PARTITION BY stream ORDER BY run_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM r) SELECT stream, run_no, rows, coalesce(b > 0 AND rows / b < 0.8, b > 0) AS dropped FROM x""")
def coverage_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stream"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("rows"))
    runs = d.withColumn("run_no", F.row_number().over(Window.partitionBy("stream").orderBy("day")))
    return C.coverage_drop(runs).select("stream", "run_no", "rows", "dropped")


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'source' END, CASE WHEN o_orderkey % 7 = 0 THEN 'run_id' END, CASE WHEN o_orderkey % 11 = 0 THEN 'knowable_at' END], lambda x: x IS NOT NULL), ',') AS missing FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.when(k % 5 == 0, "").otherwise("v").alias("source"), F.when(k % 7 != 0, k).alias("run_id"), F.lit("h").alias("payload_sha256"), F.col("o_orderdate").alias("fetched_at"), F.when(k % 11 != 0, F.col("o_orderdate")).alias("knowable_at"))
    return C.incomplete_provenance(o).select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query("""SELECT o_orderpriority AS stream, CAST(max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR) AS last_complete, CASE arg_max(o_orderstatus, (o_orderdate, o_orderkey)) WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS latest_status FROM orders GROUP BY 1""")
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stream"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("run_no"), F.when(s == "F", "COMPLETE").when(s == "O", "FAILED").otherwise("RUNNING").alias("status"))
    return C.freshness(runs).select("stream", *_text("last_complete"), "latest_status")


@query("""WITH i AS (SELECT user_id % 10 AS source, event_id % 600 - 20 AS d, event_id % 97 AS p, event_id % 6 = 0 AS backlog, event_id % 11 = 0 AS undated, hour(ts) BETWEEN 9 AND 15 AS h FROM events), g AS (SELECT *, NOT backlog AND NOT undated AS live FROM i)
SELECT source, count(*) FILTER (WHERE live AND d >= 0) AS detected, round(median(d) FILTER (WHERE live AND d >= 0), 3) AS detection_s, round(median(d) FILTER (WHERE live AND d >= 0 AND h), 3) AS detection_hours_s, round(median(d) FILTER (WHERE live AND d >= 0 AND NOT h), 3) AS detection_off_s, round(median(p), 3) AS ingestion_s, round(median(d + p) FILTER (WHERE live AND d >= 0), 3) AS end_to_end_s, count(*) FILTER (WHERE live AND d < 0) AS skewed FROM g GROUP BY 1""")
def source_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = lambda e: f"make_dt_interval(0, 0, 0, CAST({e} AS INT))"
    i = table(spark, sf_dir, "events").selectExpr("user_id % 10 AS source", "ts AS discovered_at", f"CASE WHEN event_id % 11 <> 0 THEN ts - {sec('event_id % 600 - 20')} END AS published_at", f"ts + {sec('event_id % 97')} AS processed_at", "event_id % 6 = 0 AS backlog", "hour(ts) BETWEEN 9 AND 15 AS in_hours")
    got = C.latency(i, ["source"])
    return got.select("source", "detected", *[F.round(c, 3).alias(c) for c in ("detection_s", "detection_hours_s", "detection_off_s", "ingestion_s", "end_to_end_s")], "skewed")


@query("""WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 1 THEN 'NOT_APPLICABLE' WHEN 2 THEN 'MALFORMED_INPUT' WHEN 3 THEN 'MISSING_INPUT' WHEN 4 THEN 'INSUFFICIENT_HISTORY' WHEN 5 THEN 'UNKNOWN' END AS r, o_orderkey % 3 AS f, o_orderkey % 4 = 0 AS bs, o_orderkey % 5 = 0 AS ns, o_orderkey % 10 = 9 AS late FROM orders)
SELECT k AS o_orderkey, CASE WHEN late AND f = 2 THEN 'NOT_AVAILABLE_HISTORICALLY' WHEN r IS NULL THEN 'VALID' WHEN r = 'NOT_APPLICABLE' THEN r WHEN r IN ('MALFORMED_INPUT', 'UNKNOWN') THEN 'INVALID' WHEN (f = 1 AND ns) OR (f = 0 AND bs) THEN 'STALE' ELSE 'MISSING_INPUT' END AS status FROM x""")
def availability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    reason = F.expr("element_at(array(NULL, 'NOT_APPLICABLE', 'MALFORMED_INPUT', 'MISSING_INPUT', 'INSUFFICIENT_HISTORY', 'UNKNOWN', NULL), CAST(o_orderkey % 7 AS INT) + 1)")
    families = F.expr("array(element_at(array('daily_bar', 'multi_news', 'fii_dii'), CAST(o_orderkey % 3 AS INT) + 1))")
    collected = F.when(k % 10 == 9, F.array(F.lit("daily_bar"), F.lit("multi_news"))).otherwise(F.array(F.lit("daily_bar"), F.lit("multi_news"), F.lit("fii_dii")))
    return table(spark, sf_dir, "orders").select(k, C.availability(reason, families, collected, k % 4 == 0, k % 5 == 0).alias("status"))


@query("""SELECT event_type, CAST(ceil(quantile_cont(event_id % 5000 + 0.25, 0.99) / 60) * 60 AS BIGINT) AS seconds, count(*) AS rows FROM events GROUP BY 1""")
def live_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("known", F.expr("ts + make_dt_interval(0, 0, 0, CAST(event_id % 5000 AS INT)) + INTERVAL '0.25' SECOND"))
    return C.live_lag(e, ["event_type"], F.col("known"), F.col("ts"))


@query("""SELECT item_id, key, links FROM (SELECT l_orderkey AS item_id, l_suppkey AS key, count(*) OVER (PARTITION BY l_orderkey) AS links, row_number() OVER (PARTITION BY l_orderkey ORDER BY m DESC, l_suppkey) AS r FROM (SELECT l_orderkey, l_suppkey, max(l_discount) AS m FROM lineitem GROUP BY 1, 2)) WHERE r = 1""")
def best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("key")).agg(F.max("l_discount").alias("confidence"))  # noqa: E741
    return C.best_links(l)


_INSIDE = """WITH t AS (SELECT event_id AS trade_id, user_id AS key, ts AS a, ts + to_hours(CAST(event_id % 60 AS INTEGER)) AS b FROM events WHERE event_type = 'purchase'), n AS (SELECT event_id AS id, user_id AS key, ts FROM events WHERE event_type = 'view')"""


def _trades(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.where("event_type = 'purchase'").selectExpr("event_id AS trade_id", "user_id AS key", "ts AS entry_at", "ts + make_dt_interval(0, CAST(event_id % 60 AS INT), 0, 0) AS exit_at")
    return t, e.where("event_type = 'view'").selectExpr("event_id AS item_id", "event_id AS signal_id", "user_id AS key", "ts AS knowable_at", "ts AS at")


@query(_INSIDE + " SELECT trade_id, id AS item_id FROM t JOIN n ON n.key = t.key AND n.ts > t.a AND n.ts < t.b")
def news_in_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _trades(spark, sf_dir)
    return C.news_in_trades(t, n.select("item_id", "key", "knowable_at"))


@query(_INSIDE + " SELECT n.id AS signal_id, count(t.trade_id) AS open_trades FROM n LEFT JOIN t ON n.key = t.key AND t.a <= n.ts AND n.ts < t.b GROUP BY 1")
def signals_in_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _trades(spark, sf_dir)
    return C.inside_trades(n.select("signal_id", "key", "at"), t)


@query("""SELECT key, close, volume FROM (SELECT p_partkey AS key, p_brand AS sector, p_retailprice AS close, p_size * 100 AS volume, p_partkey % 40 AS pe FROM part WHERE p_retailprice >= 905 ORDER BY p_size * 100 DESC, p_partkey LIMIT 60 OFFSET 20) WHERE pe BETWEEN 5 AND 25""")
def stock_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("sector"), F.col("p_retailprice").alias("close"), (F.col("p_size") * 100).alias("volume"), (F.col("p_partkey") % 40).alias("pe"))
    return C.screen(p, price=(905, None), pe=(5, 25), limit=60, offset=20).select("key", "close", "volume")


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '2-HIGH' AND o_custkey % 4 = 3""")
def filtered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("tags", F.array((F.col("o_custkey") % 4).cast("string"), F.lit("all")))
    return C.where_any(o, ("o_orderstatus", "o_orderpriority", "tags", "source"), o_orderstatus=["F", "P"], o_orderpriority="2-HIGH", tags="3", source=None).select("o_orderkey", "o_orderpriority")


@query("""WITH t AS (SELECT o_orderpriority AS strategy, o_totalprice - 150000 AS net, (o_orderkey % 41 - 20) / 10.0 AS r, o_orderkey % 3 AS vix, o_orderstatus AS state FROM orders), x AS (SELECT strategy, net, r, 'vix' AS axis, CAST(vix AS VARCHAR) AS state FROM t UNION ALL SELECT strategy, net, r, 'trend', state FROM t)
SELECT strategy, axis, state, count(*) AS trades, round(avg((net > 0)::INTEGER), 6) AS hit_rate, round(sum(net), 2) AS net, round(avg(r), 6) AS mean_r FROM x GROUP BY 1, 2, 3""")
def regime_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("strategy"), (F.col("o_totalprice") - 150000).alias("net"), ((k % 41 - 20) / 10.0).alias("r"), (k % 3).alias("vix"), F.col("o_orderstatus").alias("trend"))
    got = C.by_axis(t, ["vix", "trend"])
    return got.select("strategy", "axis", "state", "trades", F.round("hit_rate", 6).alias("hit_rate"), F.round("net", 2).alias("net"), F.round("mean_r", 6).alias("mean_r"))
