"""Queries over vendor payloads made from the tables, and over training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as D
from ..sources import vendor as V
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


def _days(spark, sf_dir):
    """The days of the orders with a number from 0."""
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("n", F.datediff("day", F.lit("1992-01-01")))


_MS = "CAST(epoch_ms(CAST(day AS TIMESTAMP)) + {s} * 1000 - 19800000 AS BIGINT)"
_DAYS = """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), x AS (SELECT day, date_diff('day', DATE '1992-01-01', day) AS n, dayofweek(day) IN (0, 6) AS wk FROM d),
y AS (SELECT *, n % 11 = 0 AS th, n % 11 = 1 AS sp, n % 11 = 2 AS two, n % 7 = 0 OR (wk AND n % 5 <> 0) AS shut, n % 13 = 0 AS hd, n % 17 <> 0 AS cov FROM x)"""


@query(_DAYS + """, z AS (SELECT *, CASE WHEN two THEN 'SEVERAL_ENTRIES' WHEN shut AND th THEN NULL WHEN shut AND sp THEN 'LIST_OPEN_TIMINGS_CLOSED' WHEN shut AND wk AND NOT th AND NOT sp THEN NULL WHEN shut AND NOT cov THEN 'NOT_COVERED' WHEN shut THEN 'CLOSED_WEEKDAY_WITHOUT_ENTRY' WHEN th THEN 'LIST_CLOSED_TIMINGS_OPEN' WHEN sp AND hd THEN 'HOURS_DISAGREE' END AS reason FROM y)
SELECT CAST(day AS VARCHAR) AS day, CASE WHEN reason IS NULL THEN CASE WHEN shut THEN CASE WHEN th THEN 'HOLIDAY' ELSE 'WEEKEND' END WHEN sp OR wk THEN 'SPECIAL' ELSE 'NORMAL' END END AS session_type, CASE WHEN reason IS NULL THEN NOT shut END AS is_trading, CASE WHEN reason IS NULL AND NOT shut THEN 33300 END AS open_s, CASE WHEN reason IS NULL AND NOT shut AND NOT sp AND NOT wk THEN 32400 END AS preopen_s, reason FROM z""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _days(spark, sf_dir)
    ms = lambda s: (F.unix_millis(F.col("day").cast("timestamp")) + s * 1000 - 19_800_000)
    m, weekend = F.col("n") % 11, F.dayofweek("day").isin(1, 7)
    kind = F.when(m == 0, "TRADING_HOLIDAY").when(m == 1, "SPECIAL_TIMING").otherwise("SETTLEMENT_HOLIDAY")
    hours = F.when(m == 1, F.concat(F.lit('[{"exchange":"NSE","start_time":'), (ms(33_300) + F.when(F.col("n") % 13 == 0, 60_000).otherwise(0)).cast("string"), F.lit(',"end_time":'), ms(55_800).cast("string"), F.lit("}]"))).otherwise("[]")
    entry = F.concat(F.lit('{"date":"'), F.col("day").cast("string"), F.lit('","description":"x","holiday_type":"'), kind, F.lit('","closed_exchanges":'), F.when(m == 0, '["NSE","BSE"]').otherwise("[]"), F.lit(',"open_exchanges":'), hours, F.lit("}"))
    listed = d.where(m <= 2).withColumn("e", F.explode(F.when(m == 2, F.array(entry, entry)).otherwise(F.array(entry))))
    body = listed.groupBy(F.year("day")).agg(F.concat(F.lit('{"status":"success","data":['), F.array_join(F.collect_list("e"), ","), F.lit("]}")).alias("body"))
    shut = (F.col("n") % 7 == 0) | (weekend & (F.col("n") % 5 != 0))
    days = d.select("day", F.when(~shut, ms(33_300)).alias("open_ms"), F.when(~shut, ms(55_800)).alias("close_ms"), (F.col("n") % 17 != 0).alias("covered"))
    got = V.session_decisions(days, V.holidays(body.select("body")))
    return got.select(*_text("day"), "session_type", "is_trading", "open_s", "preopen_s", "reason")


@query("""WITH a AS (SELECT DISTINCT 'K' || o_custkey AS key, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'head ' || (o_orderkey % 400) END AS heading, CASE WHEN o_orderkey % 19 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 400 % 40 AS INTEGER)) END AS published, CASE WHEN o_orderkey % 400 % 3 = 0 THEN 'u' || (o_orderkey % 2) END AS url FROM orders),
n AS (SELECT heading, published, count(DISTINCT coalesce(url, '')) AS v FROM a GROUP BY 1, 2), k AS (SELECT DISTINCT key, heading, published FROM a)
SELECT key, k.heading, CAST(k.published AS VARCHAR) AS published_at, CAST(CASE WHEN k.published > TIMESTAMP '2024-01-02' THEN TIMESTAMP '2024-01-02' ELSE k.published END AS VARCHAR) AS knowable_at, CASE WHEN k.heading = ' ' THEN 'EMPTY_HEADING' WHEN k.published IS NULL THEN 'BAD_TIME' WHEN k.published > TIMESTAMP '2024-01-02' THEN 'CLOCK_SKEW' WHEN v > 1 THEN 'DUPLICATE_KEY' END AS reason
FROM k JOIN n ON n.heading = k.heading AND n.published IS NOT DISTINCT FROM k.published""")
def vendor_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    at = F.when(n % 19 == 0, F.lit('"soon"')).otherwise((F.lit(1704067200000) + (n % 400 % 40) * 3_600_000).cast("string"))
    article = F.concat(F.lit('{"heading":"'), F.when(n % 23 == 0, " ").otherwise(F.concat(F.lit("head "), (n % 400).cast("string"))), F.lit('","published_time":'), at, F.lit(',"summary":"","article_link":"'), F.when(n % 400 % 3 == 0, F.concat(F.lit("u"), (n % 2).cast("string"))).otherwise(""), F.lit('"}'))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit('"K'), F.col("o_custkey").cast("string"), F.lit('":['), F.array_join(F.collect_list(article), ","), F.lit("]")).alias("part"))
    body = o.groupBy(F.col("o_custkey") % 16).agg(F.concat(F.lit('{"status":"success","data":{'), F.array_join(F.collect_list("part"), ","), F.lit("}}")).alias("body"))
    got = V.keyed_news(body.select("body", F.lit("2024-01-02 00:00:00").cast("timestamp").alias("fetched_at")))
    return got.select("key", "heading", *_text("published_at", "knowable_at"), "reason")


@query("""SELECT s_suppkey AS subject, CASE WHEN s_suppkey % 5 NOT IN (0, 1) THEN CAST(last_day(make_date(2020 + s_suppkey % 3, 3, 1)) AS VARCHAR) END AS first_period, CASE WHEN s_suppkey % 5 NOT IN (0, 1) THEN '2025-03-31' END AS last_period, CASE s_suppkey % 5 WHEN 0 THEN 'MALFORMED_PAYLOAD' WHEN 1 THEN 'NO_PERIOD' END AS reason FROM supplier""")
def vendor_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = F.when(k % 5 == 0, F.lit('{"a"')).when(k % 5 == 1, F.lit('{"history": []}')).otherwise(F.concat(F.lit('{"history": [{"period": "Mar 2025"}, {"period": "Mar '), (k % 3 + 2020).cast("string"), F.lit('"}]}')))
    p = table(spark, sf_dir, "supplier").select(k.alias("subject"), F.lit("balance_sheet").alias("statement_type"), body.alias("body"))
    return V.statements(p).select("subject", *_text("first_period", "last_period"), "reason")


@query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NSE_EQ' ELSE 'GLOBAL_INDEX' END AS segment, CASE c_custkey % 4 WHEN 1 THEN 'X|' || c_custkey WHEN 2 THEN 'GLOBAL_INDEX|' || (c_custkey // 8) ELSE 'GLOBAL_INDEX|' || (c_custkey + 100000) END AS k FROM customer)
SELECT k AS instrument_key, segment, CASE WHEN segment = 'NSE_EQ' THEN 'NOT_GLOBAL' WHEN k LIKE 'X|%' THEN 'MALFORMED_KEY' WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'DUPLICATE_KEY' END AS reason FROM r""")
def global_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    key = F.when(k % 4 == 1, F.concat(F.lit("X|"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("GLOBAL_INDEX|"), F.floor(k / 8).cast("string"))).otherwise(F.concat(F.lit("GLOBAL_INDEX|"), (k + 100000).cast("string")))
    row = F.struct(F.when(k % 4 == 0, "NSE_EQ").otherwise("GLOBAL_INDEX").alias("segment"), key.alias("instrument_key"), F.lit("S").alias("trading_symbol"), F.lit("").alias("name"), F.lit("X").alias("exchange"))
    body = table(spark, sf_dir, "customer").groupBy(k % 10).agg(F.to_json(F.collect_list(row)).alias("body"))
    return V.global_instruments(body.select("body")).select("instrument_key", "segment", "reason")


@query("""WITH i AS (SELECT o_orderkey, o_orderkey % 6 AS m, 'S' || o_custkey AS s FROM orders) SELECT DISTINCT 'https://x.example/files/' || CASE WHEN m = 4 THEN 'nosymbol' ELSE s || '_' || o_orderkey END || '.pdf' AS source_id, CASE WHEN m <> 5 THEN 'Board Meeting ' || m END AS subject, CASE WHEN m <> 4 THEN s END AS symbol, CASE WHEN m = 3 THEN 'MALFORMED_ITEM' END AS reason FROM i WHERE m <> 4
UNION SELECT 'https://x.example/files/nosymbol.pdf', 'Board Meeting 4', NULL, NULL""")
def exchange_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 6
    link = F.concat(F.lit("https://x.example/files/"), F.when(m == 4, "nosymbol").otherwise(F.concat(F.lit("S"), F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"))), F.lit(".pdf"))
    i = table(spark, sf_dir, "orders").select(F.when(m == 3, " ").otherwise("Some Company Limited").alias("title"), link.alias("link"), F.when(m == 5, "no mark").otherwise(F.concat(F.lit("Text of it |SUBJECT: Board Meeting "), m.cast("string"))).alias("description"), F.col("o_orderdate").alias("published_at"), F.lit(None).cast("string").alias("reason"))
    return V.announcements(i).select("source_id", "subject", "symbol", "reason")


_CORE = """WITH core AS (SELECT DISTINCT l_suppkey % 40 AS session, l_partkey AS key, 'f' || l_linenumber AS f, CASE WHEN l_partkey % 6 = 0 AND l_linenumber = 2 THEN 'MISSING_INPUT' ELSE 'VALID' END AS status FROM lineitem WHERE l_linenumber <= 3),
lab AS (SELECT DISTINCT l_suppkey % 40 AS session, l_partkey AS key, 'l' || l_linenumber AS id, CASE WHEN l_partkey % 5 <> 0 AND NOT (l_partkey % 5 = 1 AND l_linenumber = 4) THEN 1.5 END AS value, CASE WHEN l_partkey % 5 = 0 THEN 'SESSION_MISSING' WHEN l_partkey % 5 = 1 AND l_linenumber = 4 THEN 'MALFORMED_PRICE' END AS reason, l_partkey % 9 = 0 AS ex FROM lineitem WHERE l_linenumber IN (4, 5)),
c AS (SELECT session, key, list_sort(list(f) FILTER (WHERE status <> 'VALID')) AS bad, count(*) FILTER (WHERE status = 'VALID') AS good FROM core GROUP BY 1, 2), l AS (SELECT session, key, list_sort(list(id) FILTER (WHERE reason IS NULL)) AS ok, count(*) AS n, count(DISTINCT coalesce(reason, '')) AS r, min(reason) AS why, count(reason) AS w, bool_or(ex) AS ex FROM lab GROUP BY 1, 2),
s AS (SELECT c.session, c.key, good, coalesce(array_to_string(bad, ','), '') AS core_not_valid, coalesce(array_to_string(ok, ','), '') AS labels_valid, array_to_string(list_filter([CASE WHEN c.key % 8 = 0 THEN 'CA_WINDOW' END, CASE WHEN ex THEN 'EXTREME_UNEXPLAINED' END], lambda x: x IS NOT NULL), ',') AS masks,
 array_to_string(list_sort(list_filter([CASE WHEN l.n IS NULL THEN 'NO_LABEL' WHEN ok IS NULL AND r = 1 AND w = l.n THEN 'LABEL_' || why WHEN ok IS NULL THEN 'LABEL_NONE_VALID' END, CASE WHEN good < 2 THEN 'CORE_FEATURE_NOT_VALID' END], lambda x: x IS NOT NULL)), ',') AS exclusions FROM c LEFT JOIN l ON l.session = c.session AND l.key = c.key)"""


def _parts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("session"), F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("n"))
    k, n = F.col("key"), F.col("n")
    core = line.where("n <= 3").select("session", "key", F.concat(F.lit("f"), n.cast("string")).alias("feature_id"), F.when((k % 6 == 0) & (n == 2), "MISSING_INPUT").otherwise("VALID").alias("status")).distinct()
    reason = F.when(k % 5 == 0, "SESSION_MISSING").when((k % 5 == 1) & (n == 4), "MALFORMED_PRICE")
    lab = line.where("n IN (4, 5)").select("session", "key", F.concat(F.lit("l"), n.cast("string")).alias("label_id"), F.when(reason.isNull(), 1.5).alias("value"), F.when(reason.isNull(), "VALID").otherwise("INVALID").alias("status"), reason.alias("reason"), F.when(k % 9 == 0, F.array(F.lit("EXTREME_UNEXPLAINED"))).otherwise(F.array().cast("array<string>")).alias("flags")).distinct()
    return core, lab, core.where(k % 8 == 0).select("session", "key")


@query(_CORE + " SELECT session, key, good AS core_valid, core_not_valid, labels_valid, masks, exclusions, exclusions = '' AS eligible FROM s")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = D.samples(*_parts(spark, sf_dir), total=2)
    return got.select("session", "key", "core_valid", *[F.array_join(c, ",").alias(c) for c in ("core_not_valid", "labels_valid", "masks", "exclusions")], "eligible")


@query("""SELECT unnest(['value_or_reason', 'flags_differ', 'label_twice', 'status_without_value', 'not_finite', 'eligible_with_exclusion', 'label_absent', 'sample_twice']) AS gate, 0::BIGINT AS violations, 'PASS' AS status""")
def dataset_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    core, lab, near = _parts(spark, sf_dir)
    return D.label_integrity(lab).unionByName(D.sample_integrity(D.samples(core, lab, near, 2), lab))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS session, l_partkey AS key FROM lineitem) SELECT session, count(*) AS predicted, count(*) FILTER (WHERE key % 11 <> 0) AS priced, count(*) FILTER (WHERE key % 11 <> 0) >= count(*) * 0.9 AS ready FROM l GROUP BY 1""")
def outcome_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("key"))
    return D.ready_outcomes(line.distinct(), line.where("key % 11 <> 0"))


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS session FROM lineitem) SELECT l_partkey AS key FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(*) FROM s)""")
def warm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("session"))
    return D.keys_on_all(b, b.select("session"))


@query("""SELECT o_orderkey AS trade_id, (SELECT arg_max(l_returnflag, (l_shipdate, l_linenumber * 100000000 + l_partkey)) FROM lineitem WHERE l_orderkey = o_orderkey) AS verdict FROM orders""")
def reviewed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trade_id"), F.col("l_shipdate").alias("at"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("review_id"), F.col("l_returnflag").alias("verdict"))
    trades = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"))
    return D.skip_counts(spark.createDataFrame([], "strategy string, reason string"), reviews, trades)[1]
