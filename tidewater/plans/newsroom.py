"""Queries over texts and payloads: titles, addresses, duplicates, scope, counts, stories, fundamentals, sources, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import fundamentals as fund
from ..operators import news
from ..sources import payloads
from ..streaming import tail
from .derive import table
from .market import AS_OF, _instant, _text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TITLE = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_TITLE} AS title, 'sha256:' || sha256(source || chr(31) || coalesce(lang, '') || chr(31) || CAST(doc_id AS VARCHAR)) AS stable_id FROM documents")
def title_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scalars.plain_title(F.col("text")).alias("title"), scalars.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("stable_id"))


@query()
def compatible_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", news.compatible_title(F.col("text")).alias("title"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS host,
 regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/amp/?$', ''), '/+$', '') AS path,
 array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[^=]*|fbclid|gclid|igshid|mc_cid|mc_eid|ref|cmpid)(=|$)')), '&') AS kept FROM p)
SELECT page_id, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url FROM q""")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.canonical_url(F.col("url")).alias("url"))


@query()
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", payloads.article_text(F.col("html")).alias("text"))


def _items(spark, sf_dir):
    """Documents as news items of 20 sources: the later of two of the same source and text within a day are duplicates."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"), "source", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("u"), (F.col("doc_id") % 180).cast("string"))).alias("url"), F.md5(F.col("text").cast("binary")).alias("content_hash"),
        F.md5(F.lower("text").cast("binary")).alias("title_hash"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").alias("at"),
    )


_ITEMS = """items AS (SELECT doc_id AS item_id, source, CASE WHEN doc_id % 9 = 0 THEN 'u' || (doc_id % 180) END AS url, md5(text) AS content_hash, md5(lower(text)) AS title_hash, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS ts FROM documents)"""
_FIRST = "first(item_id) OVER (PARTITION BY source, {k} ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query(f"""WITH {_ITEMS}, f AS (SELECT item_id, CASE WHEN url IS NOT NULL THEN {_FIRST.format(k='url')} END AS u, {_FIRST.format(k='content_hash')} AS c, {_FIRST.format(k='title_hash')} AS t FROM items)
SELECT item_id, CASE WHEN coalesce(u, c, t) IS NULL THEN 'NEW_ARTICLE' ELSE 'DUPLICATE_ARTICLE' END AS decision, CASE WHEN u IS NOT NULL THEN 'SAME_SOURCE_URL' WHEN c IS NOT NULL THEN 'SAME_SOURCE_CONTENT' WHEN t IS NOT NULL THEN 'SAME_SOURCE_TITLE' ELSE 'FIRST_SEEN' END AS rule, coalesce(u, c, t) AS related_id FROM f""")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.duplicates(_items(spark, sf_dir))


_EDIT = "CASE WHEN conv_id % 3 = 0 AND turn % 4 = 3 THEN 'Correction: ' ELSE '' END || role"


@query(f"""WITH o AS (SELECT conv_id AS item_id, turn AS t, {_EDIT} AS title, text AS body, lag({_EDIT}) OVER w AS pt, lag(text) OVER w AS pb, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT item_id, t AS "at", array_to_string(list_filter([CASE WHEN title IS NOT NULL AND title IS DISTINCT FROM pt THEN 'title' END, CASE WHEN body IS NOT NULL AND body IS DISTINCT FROM pb THEN 'body' END], lambda x: x IS NOT NULL), ',') AS changed,
 CASE WHEN title IS DISTINCT FROM pt AND title LIKE 'Correction%' AND NOT pt LIKE 'Correction%' THEN 'STORY_CORRECTION' ELSE 'STORY_UPDATE' END AS decision FROM o WHERE n > 1 AND ((title IS NOT NULL AND title IS DISTINCT FROM pt) OR (body IS NOT NULL AND body IS DISTINCT FROM pb))""")
def edit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("at"), F.expr(_EDIT).alias("title"), F.col("text").alias("body"))
    return news.edits(o, ("title", "body")).select("item_id", "at", F.array_join("changed", ",").alias("changed"), "decision")


_HEADLINE = """concat('Alpha ', CASE o_orderkey % 9 WHEN 0 THEN 'shares surge 7% on record high' WHEN 1 THEN 'wins Rs 2,500 crore contract' WHEN 2 THEN 'Q3 results: net profit falls' WHEN 3 THEN 'holds steady' WHEN 4 THEN 'breaking: probe into default'
 WHEN 5 THEN 'Wall Street and Nikkei cues' WHEN 6 THEN 'weather report' WHEN 7 THEN 'gains then losses' ELSE 'raises Rs 1.5 lakh crore' END)"""
_CATEGORY = "CASE o_orderkey % 7 WHEN 0 THEN 'RESULTS' WHEN 1 THEN 'ORDER_CONTRACT' WHEN 2 THEN 'INVESTIGATION' WHEN 3 THEN 'INFLATION' WHEN 4 THEN 'FUNDRAISING' ELSE 'OTHER' END"
_KIND = "CASE WHEN o_orderkey % 31 = 0 THEN 'EXCHANGE' WHEN o_orderkey % 29 = 0 THEN 'REGULATOR' ELSE 'HEADLINE' END"
_MENTION = "CASE o_orderkey % 8 WHEN 0 THEN 'INDEX' WHEN 1 THEN 'CURRENCY' WHEN 2 THEN 'COURT' WHEN 3 THEN 'COMMODITY' WHEN 4 THEN 'SECTOR' ELSE 'NONE' END"


def _headlines(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS item_id", f"{_HEADLINE} AS title", f"{_CATEGORY} AS category", f"{_KIND} AS source_kind", "CAST(o_orderkey % 3 = 0 AS INT) AS n_companies", f"array({_MENTION}) AS mention_types",
        "o_custkey % 40 AS publisher", "o_custkey % 15 AS story_id", "timestamp_ntz'2024-01-17' + make_dt_interval(0, 0, CAST(o_orderkey % 5000 AS INT), 0) AS knowable_at",
    )


_HEADS = f"""h AS (SELECT o_orderkey AS item_id, {_HEADLINE} AS title, {_CATEGORY} AS cat, {_KIND} AS kind, CAST(o_orderkey % 3 = 0 AS INTEGER) AS nc, {_MENTION} AS m, o_custkey % 40 AS publisher, o_custkey % 15 AS story_id, TIMESTAMP '2024-01-17' + to_minutes(CAST(o_orderkey % 5000 AS INTEGER)) AS knowable_at FROM orders)"""
_in = lambda names: ", ".join(f"'{n}'" for n in names)


@query(f"""WITH {_HEADS}, s AS (SELECT *, list_filter([CASE WHEN cat IN ({_in(news.REGULATORY_EVENTS)}) OR kind = 'REGULATOR' OR (nc = 0 AND m IN ('REGULATOR', 'COURT')) THEN 'REGULATORY' END, CASE WHEN cat IN ({_in(news.CORPORATE_EVENTS)}) THEN 'CORPORATE' END,
 CASE WHEN nc > 0 AND cat NOT IN ({_in(news.CORPORATE_EVENTS)}) THEN 'COMPANY' END, CASE WHEN m = 'CURRENCY' THEN 'CURRENCY' END, CASE WHEN m = 'COMMODITY' THEN 'COMMODITY' END, CASE WHEN cat IN ({_in(news.MACRO_EVENTS)}) THEN 'MACRO' END,
 CASE WHEN regexp_matches(title, '{news.GLOBAL_WORDS}') THEN 'GLOBAL_MARKET' END, CASE WHEN m = 'SECTOR' THEN 'SECTOR' END, CASE WHEN m = 'INDEX' THEN 'MARKET_WIDE' END], lambda x: x IS NOT NULL) AS hits FROM h),
p AS (SELECT *, coalesce(hits[1], CASE WHEN kind = 'EXCHANGE' OR regexp_matches(title, '{news.CORPORATE_WORDS}') THEN 'CORPORATE' WHEN regexp_matches(title, '{news.MARKET_WORDS}') THEN 'MARKET_WIDE' ELSE 'IRRELEVANT' END) AS scope FROM s)
SELECT item_id, scope, array_to_string(hits[2:], ',') AS other_scopes, CASE WHEN len(hits) > 0 AND (cat <> 'OTHER' OR nc > 0 OR kind = 'REGULATOR') THEN 0.8 WHEN len(hits) > 0 THEN 0.6 WHEN scope = 'IRRELEVANT' THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence FROM p""")
def scope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = news.scope(_headlines(spark, sf_dir))
    return got.select("item_id", "scope", F.array_join("other_scopes", ",").alias("other_scopes"), F.col("confidence").cast("double").alias("confidence"))


_DIR = f"CASE WHEN regexp_matches(title, '{news.POSITIVE_WORDS}') AND regexp_matches(title, '{news.NEGATIVE_WORDS}') THEN 'MIXED' WHEN regexp_matches(title, '{news.POSITIVE_WORDS}') THEN 'POSITIVE' WHEN regexp_matches(title, '{news.NEGATIVE_WORDS}') THEN 'NEGATIVE' WHEN regexp_matches(title, '{news.NEUTRAL_WORDS}') THEN 'NEUTRAL' ELSE 'UNKNOWN' END"


@query(f"""WITH {_HEADS}, a AS (SELECT *, {_DIR} AS direction, CASE WHEN title LIKE '%2,500 crore%' THEN 2500.0 WHEN title LIKE '%1.5 lakh crore%' THEN 150000.0 END AS cr FROM h)
SELECT item_id, direction, CASE WHEN (cat IN ({_in(news.SIZED_EVENTS)}) AND cr >= 1000) OR (nc > 0 AND title LIKE '%7!%%' ESCAPE '!') THEN 'HIGH' WHEN cat IN ({_in(news.HIGH_IMPACT)}) THEN 'HIGH' WHEN cat IN ({_in(news.MEDIUM_IMPACT)}) THEN 'MEDIUM' WHEN nc > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS impact,
 cr::DOUBLE AS crore FROM a""")
def assess_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _headlines(spark, sf_dir)
    return h.select("item_id", news.direction(F.col("title")).alias("direction"), news.impact(F.col("title"), F.col("category"), F.col("n_companies")).alias("impact"), scalars.crore_amount(F.col("title")).alias("crore"))


@query(f"""WITH {_HEADS}, a AS (SELECT *, {_DIR} AS direction, regexp_matches(title, '{news.BREAKING_WORDS}') AS b, epoch_us(TIMESTAMP '{AS_OF}') / 3.6e9 - epoch_us(knowable_at) / 3.6e9 AS age FROM h WHERE knowable_at < TIMESTAMP '{AS_OF}')
SELECT cat AS category, count(*) FILTER (WHERE age <= 1)::DOUBLE AS news_count_1h, count(*) FILTER (WHERE age <= 4)::DOUBLE AS news_count_4h, count(*) FILTER (WHERE age <= 24)::DOUBLE AS news_count_24h, count(*) FILTER (WHERE age <= 72)::DOUBLE AS news_count_3d,
 count(DISTINCT publisher) FILTER (WHERE age <= 24)::DOUBLE AS unique_publishers_24h, count(DISTINCT story_id) FILTER (WHERE age <= 24)::DOUBLE AS story_count_24h, count(*) FILTER (WHERE age <= 24 AND direction = 'NEGATIVE')::DOUBLE AS negative_count_24h, count(*) FILTER (WHERE age <= 24 AND b)::DOUBLE AS breaking_count_24h,
 round(CASE WHEN count(*) FILTER (WHERE age <= 24) > 0 THEN avg(CASE direction WHEN 'POSITIVE' THEN 1.0 WHEN 'NEGATIVE' THEN -1.0 ELSE 0.0 END) FILTER (WHERE age <= 24) END, 6) AS sentiment_24h,
 round(count(*) FILTER (WHERE age <= 1) / nullif(count(*) FILTER (WHERE age <= 24 AND age > 1) / 23.0, 0), 6) AS velocity_1h FROM a GROUP BY 1""")
def news_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _headlines(spark, sf_dir)
    h = h.withColumns({"direction": news.direction(F.col("title")), "is_breaking": F.col("title").rlike(news.BREAKING_WORDS)})
    got = news.news_counts(h, _instant(), F.lit(True), ["category"])
    names = ("news_count_1h", "news_count_4h", "news_count_24h", "news_count_3d", "unique_publishers_24h", "story_count_24h", "negative_count_24h", "breaking_count_24h", "sentiment_24h", "velocity_1h")
    return got.select("category", *[F.round(F.col(f"{n}.value"), 6).alias(n) for n in names])


@query("""WITH t AS (SELECT item_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(item_id AS INTEGER)) AS at, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('the','and','for','with','from','after','over','into','its','this','that','will','says','said') AND NOT regexp_full_match(w, '\\d+'))) AS w FROM benchmark),
p AS (SELECT a.item_id, b.item_id AS earlier_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM t a JOIN t b ON b.at < a.at AND a.at - b.at <= INTERVAL 3 HOUR WHERE len(a.w) > 0 AND len(b.w) > 0)
SELECT item_id, first(earlier_id ORDER BY j DESC, earlier_id) AS earlier_id, round(max(j), 6) AS jaccard FROM p WHERE j >= 0.7 GROUP BY 1""".replace("\\\\", "\\"))
def story_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(item_id AS INT), 0)").alias("at"))
    return news.similar_pairs(d)


@query()
def story_assign_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``story_assign`` over every document's whole text; SQL pairs all documents of a window and is too slow for it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").alias("at"))
    return news.similar_pairs(d)


@query(f"""WITH {_HEADS} SELECT story_id, count(*) AS members, count(DISTINCT publisher) AS publishers, CAST(min(knowable_at) AS VARCHAR) AS first_at, CAST(max(knowable_at) AS VARCHAR) AS last_at, bool_or(regexp_matches(title, '{news.BREAKING_WORDS}')) AS is_breaking FROM h GROUP BY 1""")
def story_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _headlines(spark, sf_dir).withColumns({"at": F.col("knowable_at"), "is_breaking": F.col("title").rlike(news.BREAKING_WORDS)})
    got = news.story_view(h)
    return got.select("story_id", "members", F.size("publishers").cast("long").alias("publishers"), *_text("first_at", "last_at"), "is_breaking")


def _statements(spark, sf_dir):
    """Quarterly values per supplier from line items, each known twice: first in part, then whole."""
    line = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz'1999-01-01'")
    period = F.last_day(F.make_date(F.year("l_shipdate"), (F.quarter("l_shipdate") * 3).cast("int"), F.lit(1)))
    q = line.groupBy(F.col("l_suppkey").alias("key"), period.alias("period")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    both = q.select("key", F.lit("profit").alias("item"), "period", F.explode(F.array(F.struct(F.lit(1).alias("snapshot_id"), (F.col("v") / 2).alias("value"), F.date_add("period", 20).alias("knowable_at")), F.struct(F.lit(2).alias("snapshot_id"), F.col("v").alias("value"), F.date_add("period", 50).alias("knowable_at")))).alias("s"))
    return both.select("key", "item", "period", "s.*")


_STATEMENTS = """q AS (SELECT l_suppkey AS key, last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)) AS period, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2),
m AS (SELECT key, period, CASE WHEN period + 50 < DATE '1998-11-25' THEN v WHEN period + 20 < DATE '1998-11-25' THEN v / 2 END AS value FROM q)"""


@query(f"""WITH {_STATEMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY period DESC) AS r, max(period) OVER (PARTITION BY key) AS last FROM m WHERE value IS NOT NULL),
t AS (SELECT key, max(period) AS period, CASE WHEN count(*) FILTER (WHERE period = last_day(CAST(last - to_months(CAST(3 * (r - 1) AS INTEGER)) AS DATE))) = 4 THEN sum(value) END AS ttm FROM r WHERE r <= 4 GROUP BY key),
y AS (SELECT a.key, a.value / b.value - 1 AS growth FROM (SELECT DISTINCT ON (key) * FROM m WHERE value IS NOT NULL ORDER BY key, period DESC) a LEFT JOIN m b ON b.key = a.key AND b.period = last_day(CAST(a.period - INTERVAL 12 MONTH AS DATE)) AND b.value IS NOT NULL)
SELECT t.key, CAST(t.period AS VARCHAR) AS period, round(t.ttm, 2) AS ttm, round(y.growth, 6) AS growth FROM t JOIN y ON y.key = t.key""")
def trailing_and_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fund.merged(_statements(spark, sf_dir), F.lit("1998-11-25").cast("date"))
    t, y = fund.trailing(m, "profit"), fund.year_on_year(m, "profit")
    return t.join(y, "key").select("key", *_text("period"), F.round("ttm", 2).alias("ttm"), F.round("growth.value", 6).alias("growth"))


@query("""SELECT c_custkey, round(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / 100 END, 6) AS ratio, CASE WHEN c_custkey % 11 = 0 THEN 'MALFORMED_INPUT' WHEN c_custkey % 3 = 0 THEN 'MISSING_INPUT' END AS reason FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, NULL, 'MALFORMED_INPUT' FROM customer WHERE c_custkey % 11 = 0""")
def vendor_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit('[{"name":"P/B","company":"1","sector":"2"}'), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(',{"name":"P/E","company":"'), F.format_number(F.col("c_acctbal") / 100, 6), F.lit('","sector":"20.5%"}'))).otherwise(""), F.lit("]"))
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "{broken").otherwise(text).alias("payload"))
    got = fund.vendor_ratio(c, "payload", "P/E")
    return got.select("c_custkey", F.round("ratio.value", 6).alias("ratio"), F.col("ratio.reason").alias("reason"))


@query("""WITH c AS (SELECT o_custkey AS key, o_orderkey % 4 AS slot, count(DISTINCT round(o_totalprice, 2)) AS v, min(round(o_totalprice, 2)) AS close FROM orders GROUP BY 1, 2)
SELECT key, CAST(TIMESTAMP '2024-01-01 03:45:00' + to_minutes(CAST(slot AS INTEGER)) AS VARCHAR) AS start, round(close, 2) AS close, CASE WHEN v > 1 THEN 'CONFLICTING_DUPLICATE' END AS reason FROM c""")
def candle_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.format_string("%.2f", "o_totalprice")
    start = F.date_format(F.expr("timestamp'2024-01-01 03:45:00' + make_dt_interval(0, 0, CAST(o_orderkey % 4 AS INT), 0)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row = F.concat(F.lit('["'), start, F.lit('",'), price, F.lit(","), price, F.lit(","), price, F.lit(","), price, F.lit(",10,0]"))
    bodies = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit('{"status":"success","data":{"candles":['), F.array_join(F.collect_list(row), ","), F.lit("]}}")).alias("body"))
    bodies = bodies.withColumns({"fetched_at": F.lit("2024-01-02 00:00:00").cast("timestamp"), "session_open": F.lit("2024-01-01 03:45:00").cast("timestamp")})
    got = payloads.candles(bodies)
    return got.select("key", *_text("start"), F.round(F.col("close").cast("double"), 2).alias("close"), "reason")


@query("SELECT CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'k' END AS field, count(*) AS payloads FROM events GROUP BY 1")
def payload_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.drift(table(spark, sf_dir, "events"), "props", {"declared"})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT o_orderkey, CAST(CASE WHEN m * 3 <= 12 THEN last_day(make_date(y, ((o_orderkey % 4) * 3 + 3)::BIGINT, 1)) END AS VARCHAR) AS period_end FROM (SELECT o_orderkey, 1 AS m, CASE WHEN last_day(make_date(year(o_orderdate), ((o_orderkey % 4) * 3 + 3)::BIGINT, 1)) <= CAST(o_orderdate AS DATE) THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS y FROM orders)""")
def fiscal_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # remainders 0 to 3 stand for the quarters that end in March, June, September and December
    quarter = F.when(F.col("o_orderkey") % 4 == 0, 4).otherwise((F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.fiscal_quarter_end(quarter, F.to_date("o_orderdate")).cast("string").alias("period_end"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream until nothing is left; equal to the batch read."""
    from ..session import scratch

    at = scratch(spark, "stream-tail")
    stream = spark.readStream.schema(tail.TICKS).parquet(_folder(spark, sf_dir))
    tail.run_to(stream.select("event_id", "user_id", "event_type", "value"), f"{at}/out", f"{at}/offsets")
    return spark.read.parquet(f"{at}/out")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 5 MINUTE AS w FROM events), b AS (SELECT event_type AS key, date_trunc('hour', ts) AS bucket, count(*) AS volume, max(value) AS high FROM events GROUP BY 1, 2)
SELECT key, CAST(bucket AS VARCHAR) AS bucket, volume, high FROM b, m WHERE bucket + INTERVAL 1 HOUR <= w""")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final bars of the streamed events: those whose end and settling delay the watermark has passed."""
    from ..session import scratch

    at = scratch(spark, "stream-bars")
    stream = spark.readStream.schema(tail.TICKS).parquet(_folder(spark, sf_dir))
    tail.run_to(tail.window_bars(stream), f"{at}/out", f"{at}/offsets")
    return spark.read.parquet(f"{at}/out").select("key", *_text("bucket"), "volume", "high")


@query()
def tracker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    plans = e.groupBy(F.col("user_id").alias("plan_id")).agg(F.lit(20.0).alias("entry_low"), F.lit(80.0).alias("entry_high"), F.lit(120.0).alias("t1"), F.lit(200.0).alias("t2"), F.lit(5.0).alias("stop"))
    prices = e.select(F.col("user_id").alias("plan_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")).join(plans, "plan_id")
    return tail.track_batch(prices)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder glob that a stream source takes: the table may be a file or a folder."""
    return f"{sf_dir}/events.parque[t]"


