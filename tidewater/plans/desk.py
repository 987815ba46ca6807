"""Queries over snapshot features: news families, auction, events, flows, finality, boards and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news, snapshots
from .derive import bars, bars_sql, table
from .market import AS_OF, _instant
from .newsroom import _DIR, _HEADS, _headlines, _in

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with scope, direction, impact, and flags by rule of their number."""
    h = _headlines(spark, sf_dir)
    return h.withColumns(
        {
            "source": F.col("item_id") % 12, "story_founder": F.col("item_id") % 5 == 0, "scope": F.when(F.col("item_id") % 6 == 0, "MARKET_WIDE").when(F.col("item_id") % 6 == 1, "CURRENCY").otherwise("COMPANY"),
            "direction": news.direction(F.col("title")), "impact": F.when(F.col("item_id") % 4 == 0, "HIGH").otherwise("LOW"), "is_breaking": F.col("title").rlike(news.BREAKING_WORDS),
            "is_correction": F.col("item_id") % 23 == 0, "is_edited": F.col("item_id") % 17 == 0, "is_duplicate": F.col("item_id") % 10 == 9,
        }
    )


_NEWS = f"""WITH {_HEADS}, a AS (SELECT *, item_id % 12 AS source, item_id % 5 = 0 AS founder, CASE item_id % 6 WHEN 0 THEN 'MARKET_WIDE' WHEN 1 THEN 'CURRENCY' ELSE 'COMPANY' END AS scope, {_DIR} AS direction, item_id % 4 = 0 AS high,
 regexp_matches(title, '{news.BREAKING_WORDS}') AS b, item_id % 23 = 0 AS corr, item_id % 17 = 0 AS edited, item_id % 10 = 9 AS dup, epoch_us(TIMESTAMP '{AS_OF}') / 3.6e9 - epoch_us(knowable_at) / 3.6e9 AS age0 FROM h WHERE knowable_at < TIMESTAMP '{AS_OF}'),
n AS (SELECT *, CASE WHEN NOT dup THEN age0 END AS age FROM a)"""


@query(_NEWS + f""" SELECT kind AS source_kind, count(*) FILTER (WHERE age <= 24)::DOUBLE AS news_count_24h, count(DISTINCT publisher) FILTER (WHERE age <= 1)::DOUBLE AS unique_publishers_1h, count(DISTINCT source) FILTER (WHERE age <= 24)::DOUBLE AS unique_sources_24h,
 count(*) FILTER (WHERE age <= 24 AND high)::DOUBLE AS high_relevance_news_count_24h, count(*) FILTER (WHERE age <= 24 AND cat IN ({_in(news.REGULATORY_EVENTS)}))::DOUBLE AS regulatory_news_count_24h, count(*) FILTER (WHERE age <= 24 AND cat IN ({_in(news.CORPORATE_EVENTS)}))::DOUBLE AS corporate_news_count_24h,
 count(*) FILTER (WHERE age <= 24 AND cat IN ({_in(news.MACRO_EVENTS)}))::DOUBLE AS macro_news_count_24h, count(*) FILTER (WHERE age <= 24 AND scope = 'CURRENCY')::DOUBLE AS currency_news_count_24h, count(*) FILTER (WHERE age <= 24 AND scope = 'MARKET_WIDE')::DOUBLE AS market_wide_news_count_24h,
 count(*) FILTER (WHERE age <= 24 AND corr)::DOUBLE AS correction_count_24h, count(*) FILTER (WHERE age <= 24 AND edited)::DOUBLE AS edited_news_count_24h, count(*) FILTER (WHERE dup AND age0 <= 24)::DOUBLE AS duplicate_count_24h,
 count(DISTINCT story_id) FILTER (WHERE age <= 24)::DOUBLE AS story_group_count_24h, count(DISTINCT story_id) FILTER (WHERE age <= 24 AND founder)::DOUBLE AS new_story_count_24h,
 round(count(*) FILTER (WHERE age <= 24) / nullif(count(*) FILTER (WHERE age > 24 AND age <= 72) / 2.0, 0), 6) AS news_velocity_24h, round(min(age) FILTER (WHERE high) * 3600, 1) AS time_since_last_high_relevance_news_s FROM n GROUP BY 1""")
def market_news_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = snapshots.market_news(_news(spark, sf_dir), _instant(), F.lit(True), ["source_kind"])
    names = "news_count_24h unique_publishers_1h unique_sources_24h high_relevance_news_count_24h regulatory_news_count_24h corporate_news_count_24h macro_news_count_24h currency_news_count_24h market_wide_news_count_24h correction_count_24h edited_news_count_24h duplicate_count_24h story_group_count_24h new_story_count_24h news_velocity_24h".split()
    return got.select("source_kind", *[F.round(F.col(f"{n}.value"), 6).alias(n) for n in names], F.round("time_since_last_high_relevance_news_s.value", 1).alias("time_since_last_high_relevance_news_s"))


@query(_NEWS + """, k AS (SELECT c_custkey AS key FROM customer), l AS (SELECT o.o_custkey AS key, a.* FROM a JOIN orders o ON o.o_orderkey = a.item_id),
g AS (SELECT key, count(*) FILTER (WHERE age0 <= 24) AS n24, count(*) FILTER (WHERE age0 <= 72) AS n72, count(DISTINCT story_id) FILTER (WHERE age0 <= 24) AS s, count(*) FILTER (WHERE age0 <= 24 AND corr) AS c,
 avg(CASE direction WHEN 'POSITIVE' THEN 1.0 WHEN 'NEGATIVE' THEN -1.0 ELSE 0.0 END) FILTER (WHERE age0 <= 72) AS m FROM l GROUP BY 1)
SELECT k.key, coalesce(n24, 0)::DOUBLE AS company_count_24h, coalesce(n72, 0)::DOUBLE AS company_count_3d, coalesce(s, 0)::DOUBLE AS company_story_count_24h, coalesce(c, 0)::DOUBLE AS company_correction_count_24h, round(m, 6) AS company_sentiment_3d, CASE WHEN m IS NULL THEN 'NOT_APPLICABLE' END AS company_sentiment_3d_reason FROM k LEFT JOIN g ON g.key = k.key""")
def company_news_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("key"))
    links = _news(spark, sf_dir).join(owner, "item_id")
    got = snapshots.company_news(links, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), _instant(), F.lit(True))
    names = "company_count_24h company_count_3d company_story_count_24h company_correction_count_24h company_sentiment_3d".split()
    return got.select("key", *[F.round(F.col(f"{n}.value"), 6).alias(n) for n in names], F.col("company_sentiment_3d.reason").alias("company_sentiment_3d_reason"))


@query("""WITH t AS (SELECT user_id AS key, last(struct_pack(p := value, b := event_id % 100, a := event_id % 40, q := event_id % 1000) ORDER BY ts, event_id) AS t FROM events GROUP BY 1),
c AS (SELECT c_custkey AS key, c_acctbal AS pc FROM customer)
SELECT c.key, round(CASE WHEN t.t IS NOT NULL AND pc > 0 THEN t.t.p / pc - 1 END, 6) AS preopen_gap_pct, CASE WHEN t.t IS NULL THEN 'MISSING_INPUT' WHEN pc <= 0 THEN 'DIVISION_UNDEFINED' END AS preopen_gap_pct_reason,
 round((t.t.b - t.t.a) / nullif(t.t.b + t.t.a, 0)::DOUBLE, 6) AS preopen_imbalance, t.t.q::DOUBLE AS preopen_ieq FROM c LEFT JOIN t ON t.key = c.key""")
def preopen_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("value").alias("price"), (F.col("event_id") % 100).alias("bid"), (F.col("event_id") % 40).alias("ask"), (F.col("event_id") % 1000).alias("quantity"))
    context = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("previous_close"), F.lit(500.0).alias("average_volume"))
    got = snapshots.preopen(ticks, context)
    return got.select("key", F.round("preopen_gap_pct.value", 6).alias("preopen_gap_pct"), F.col("preopen_gap_pct.reason").alias("preopen_gap_pct_reason"), F.round("preopen_imbalance.value", 6).alias("preopen_imbalance"), F.col("preopen_ieq.value").alias("preopen_ieq"))


@query("""WITH x AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-30')
SELECT c_custkey AS key, date_diff('day', max(day), DATE '1997-06-30')::DOUBLE AS ca_days_since_any, date_diff('day', max(day) FILTER (WHERE p IN ('1-URGENT', '2-HIGH')), DATE '1997-06-30')::DOUBLE AS ca_days_since_split FROM customer LEFT JOIN x ON key = c_custkey GROUP BY 1""")
def ca_days_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("ex_date"), F.col("o_orderpriority").alias("action_type"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    got = snapshots.days_since_action(actions, keys, F.lit("1997-06-30").cast("date"), {"any": [], "split": ["1-URGENT", "2-HIGH"]})
    return got.select("key", *[F.col(f"ca_days_since_{k}.value").alias(f"ca_days_since_{k}") for k in ("any", "split")])


_EVENTS = """e AS (SELECT o_custkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'INTIMATION' ELSE 'OUTCOME' END AS kind, last_day(CAST(o_orderdate AS DATE)) AS period_end, CAST(o_orderdate AS DATE) + (o_orderkey % 60)::INTEGER AS day, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS known_at FROM orders)"""


@query(f"""WITH {_EVENTS}, p AS (SELECT DISTINCT ON (key, period_end) * FROM e WHERE kind = 'INTIMATION' ORDER BY key, period_end, known_at DESC, event_id DESC),
n AS (SELECT key, min(day) FILTER (WHERE day >= DATE '1997-06-30') AS nx, bool_or(day = DATE '1997-06-30') AS td FROM p GROUP BY 1), o AS (SELECT key, max(day) AS la FROM e WHERE kind = 'OUTCOME' AND day <= DATE '1997-06-30' GROUP BY 1)
SELECT c_custkey AS key, date_diff('day', DATE '1997-06-30', nx)::DOUBLE AS results_days_to_next, CASE WHEN coalesce(td, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS results_today, date_diff('day', la, DATE '1997-06-30')::DOUBLE AS results_days_since FROM customer LEFT JOIN n ON n.key = c_custkey LEFT JOIN o ON o.key = c_custkey""")
def results_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    events = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, "INTIMATION").otherwise("OUTCOME").alias("kind"), F.last_day(day).alias("period_end"),
        F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("day"), F.col("o_orderkey").alias("event_id"), day.alias("known_at"),
    )
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    got = snapshots.result_events(events, keys, F.lit("1997-06-30").cast("date"), F.lit(400))
    return got.select("key", *[F.col(f"{n}.value").alias(n) for n in ("results_days_to_next", "results_today", "results_days_since")])


@query(f"""WITH o AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, round(value, -1) AS close, ts AS observed_at, event_id FROM events WHERE ts < TIMESTAMP '{AS_OF}'),
g AS (SELECT key, day, first(close ORDER BY observed_at, event_id) AS close, count(*) AS n, count(DISTINCT close) AS v, min(observed_at) AS f FROM o GROUP BY 1, 2), p AS (SELECT *, lag(close) OVER (PARTITION BY key ORDER BY day) AS pc FROM g)
SELECT key, CAST(day AS VARCHAR) AS day, close, CASE WHEN v > 1 THEN 'REVISED' WHEN n = 1 AND close = pc THEN 'PLACEHOLDER' WHEN n > 1 THEN 'CONFIRMED' WHEN f < TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY THEN 'CONFIRMED_BY_AGE' ELSE 'OPEN' END AS state FROM p""")
def label_finality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.round("value", -1).alias("close"), F.col("ts").alias("observed_at"), F.col("event_id").alias("obs_id"))
    return snapshots.finality(seen, _instant()).select("key", F.col("day").cast("string").alias("day"), "close", "state")


@query("""SELECT CASE WHEN upper(p_name) = 'PART' THEN 0 WHEN starts_with(upper(p_name), 'A') THEN 1 END AS rank, p_name AS symbol, p_partkey FROM part WHERE starts_with(upper(p_name), 'A')""")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol"), F.lit("").alias("name"), F.lit("").alias("isin"), "p_partkey")
    n = 1 << 30  # all that match
    return snapshots.search(p, "a", n).select("rank", "symbol", "p_partkey")


@query(f"""WITH {bars_sql('day')}, t AS (SELECT key, close, lead(close) OVER (PARTITION BY key ORDER BY bucket DESC) AS p, row_number() OVER (PARTITION BY key ORDER BY bucket DESC) AS r FROM bars),
m AS (SELECT key, close, close / p - 1 AS move FROM t WHERE r = 1 AND p > 0)
SELECT key, close, round(move, 6) AS move, 'UP' AS side FROM (SELECT * FROM m ORDER BY move DESC, key LIMIT 2) UNION ALL SELECT key, close, round(move, 6), 'DOWN' FROM (SELECT * FROM m ORDER BY move, key LIMIT 2)""")
def movers_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.board(bars(spark, sf_dir, "day"), 2).select("key", "close", F.round("move", 6).alias("move"), "side")
