"""Further vendor payloads: holidays and session decisions, keyed news, statements, global instruments, announcements, event calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MARKET_ZONE, parse_period, stable_id

# Holiday kinds, global segments, the announcement's subject and symbol.
HOLIDAY_KINDS = ("TRADING_HOLIDAY", "SETTLEMENT_HOLIDAY", "SPECIAL_TIMING")
GLOBAL_SEGMENTS = ("GLOBAL_INDEX", "GLOBAL_INDICATOR")
SUBJECT = r"(?i)\|\s*SUBJECT\s*:\s*(.+?)\s*$"
SYMBOL_IN_FILE = r"/([A-Z0-9&-]+)_[^/]*$"


def _seconds(ms: Column) -> Column:
    """Seconds of the market's day of an epoch in milliseconds."""
    local = F.from_utc_timestamp(F.timestamp_millis(ms), MARKET_ZONE)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def holidays(payloads: DataFrame, exchange: str = "NSE") -> DataFrame:
    """A holiday list to ``day, kind, closed, open_ms, close_ms, reason``; an unknown kind or a bad date has a reason."""
    kind = "struct<status:string,data:array<struct<date:string,description:string,holiday_type:string,closed_exchanges:array<string>,open_exchanges:array<struct<exchange:string,start_time:long,end_time:long>>>>>"
    rows = payloads.select(F.from_json("body", kind).alias("p"))
    bad = rows.where("p.data IS NULL OR p.status <> 'success'").selectExpr("CAST(NULL AS DATE) AS day", "CAST(NULL AS STRING) AS kind", "CAST(NULL AS BOOLEAN) AS closed", "CAST(NULL AS LONG) AS open_ms", "CAST(NULL AS LONG) AS close_ms", "'MALFORMED_PAYLOAD' AS reason")
    each = rows.where("p.status = 'success'").select(F.explode("p.data").alias("h"))
    mine = F.filter("h.open_exchanges", lambda e: e["exchange"] == exchange)
    day = F.try_to_date("h.date", "yyyy-MM-dd")
    hours = F.get(mine, F.lit(0))
    reason = F.when(day.isNull(), "BAD_DATE").when(~F.coalesce(F.col("h.holiday_type").isin(*HOLIDAY_KINDS), F.lit(False)), "UNKNOWN_KIND").when(F.size(mine) > 1, "SEVERAL_HOURS")
    return each.select(day.alias("day"), F.col("h.holiday_type").alias("kind"), F.coalesce(F.array_contains("h.closed_exchanges", exchange), F.lit(False)).alias("closed"), hours["start_time"].alias("open_ms"), hours["end_time"].alias("close_ms"), reason.alias("reason")).unionByName(bad)


def session_decisions(days: DataFrame, holidays: DataFrame, regular_open: int = 33_300, preopen: int = 32_400) -> DataFrame:
    """``day, session_type, is_trading, open_s, close_s, preopen_s, reason`` of each day from holiday list and timings.

    ``days``: day, open_ms, close_ms (timings of the day, null if closed), covered (whether the list covers it).
    Nothing is guessed: where the two sources disagree, or neither says why a weekday is closed, the
    day has a reason instead of a type.
    """
    h = holidays.where("reason IS NULL").groupBy("day").agg(F.count("*").alias("entries"), F.first("kind").alias("kind"), F.first("closed").alias("closed"), F.first("open_ms").alias("h_open"), F.first("close_ms").alias("h_close"))
    d = days.join(h, "day", "left")
    weekend = F.dayofweek("day").isin(1, 7)
    listed = F.col("entries").isNotNull()
    shut = F.col("open_ms").isNull()
    on = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_millis(F.col(c)), MARKET_ZONE)) != F.col("day")
    why = (
        F.when(F.col("entries") > 1, "SEVERAL_ENTRIES")
        .when(shut & listed & (F.col("kind") == "TRADING_HOLIDAY") & F.col("closed"), F.lit(None))
        .when(shut & F.col("kind").isin("SPECIAL_TIMING", "SETTLEMENT_HOLIDAY") & ~F.col("closed"), "LIST_OPEN_TIMINGS_CLOSED")
        .when(shut & weekend & ~listed, F.lit(None))
        .when(shut & ~F.col("covered"), "NOT_COVERED")
        .when(shut, "CLOSED_WEEKDAY_WITHOUT_ENTRY")
        .when(on("open_ms") | on("close_ms"), "OTHER_DATE")
        .when(F.col("close_ms") <= F.col("open_ms"), "END_NOT_AFTER_START")
        .when(F.coalesce("closed", F.lit(False)), "LIST_CLOSED_TIMINGS_OPEN")
        .when(F.col("h_open").isNotNull() & ((F.col("h_open") != F.col("open_ms")) | (F.col("h_close") != F.col("close_ms"))), "HOURS_DISAGREE")
    )
    kind = F.when(shut, F.when(listed, "HOLIDAY").otherwise("WEEKEND")).when((F.col("kind") == "SPECIAL_TIMING") | weekend, "SPECIAL").otherwise("NORMAL")
    decided = d.withColumns({"reason": why, "session_type": F.when(why.isNull(), kind), "open_s": _seconds(F.col("open_ms")), "close_s": _seconds(F.col("close_ms"))})
    known = F.col("session_type").isNotNull()
    regular = (F.col("session_type") == "NORMAL") & (F.col("open_s") == regular_open)
    return decided.select("day", "session_type", F.when(known, ~shut).alias("is_trading"), F.when(known, F.col("open_s")).alias("open_s"), F.when(known, F.col("close_s")).alias("close_s"), F.when(regular, preopen).alias("preopen_s"), "reason")


def keyed_news(payloads: DataFrame) -> DataFrame:
    """A map of key to articles to ``key, heading, published_at, knowable_at, url, body, reason``, one row per key and article.

    ``payloads``: fetched_at, body.  An article is its heading and time; of several with other fields the first in the
    payload stands and the row is marked DUPLICATE_KEY.  Published after the fetch counts from the fetch (CLOCK_SKEW).
    """
    kind = "struct<status:string,data:map<string,array<struct<heading:string,published_time:string,summary:string,article_link:string>>>>"
    p = payloads.select("fetched_at", F.from_json("body", kind).alias("p"))
    each = p.select("fetched_at", F.explode("p.data").alias("key", "articles")).select("fetched_at", "key", F.posexplode("articles").alias("no", "a"))
    ms = F.col("a.published_time").try_cast("long")
    at = F.timestamp_millis(ms)
    rows = each.select("key", "no", "fetched_at", F.col("a.heading").alias("heading"), F.when(ms > 0, at).alias("published_at"), F.nullif("a.article_link", F.lit("")).alias("url"), F.nullif("a.summary", F.lit("")).alias("body"))
    fields = F.struct("url", "body")
    one = rows.groupBy("heading", "published_at").agg(F.min_by(fields, F.struct("key", "no")).alias("_first"), F.count_distinct(fields).alias("_v"))
    links = rows.select("key", F.col("heading").alias("h"), F.col("published_at").alias("t"), "fetched_at").distinct()
    both = links.join(one, F.col("h").eqNullSafe(F.col("heading")) & F.col("t").eqNullSafe(F.col("published_at"))).drop("h", "t")
    empty = F.trim(F.coalesce("heading", F.lit(""))) == ""
    skew = F.col("published_at") > F.col("fetched_at")
    reason = F.when(empty, "EMPTY_HEADING").when(F.col("published_at").isNull(), "BAD_TIME").when(skew, "CLOCK_SKEW").when(F.col("_v") > 1, "DUPLICATE_KEY")
    return both.select("key", "heading", "published_at", F.when(skew, F.col("fetched_at")).otherwise(F.col("published_at")).alias("knowable_at"), "_first.url", "_first.body", reason.alias("reason"))


def statements(payloads: DataFrame) -> DataFrame:
    """One snapshot per payload: ``subject, statement_type, payload, first_period, last_period, reason`` (payloads: subject, statement_type, body)."""
    periods = F.array_compact(F.transform(F.regexp_extract_all("body", F.lit(r'"period"\s*:\s*"([^"]+)"'), F.lit(1)), parse_period))
    parsed = F.try_parse_json("body")
    reason = F.when(parsed.isNull(), "MALFORMED_PAYLOAD").when(F.size(periods) == 0, "NO_PERIOD")
    return payloads.select("subject", "statement_type", parsed.alias("payload"), F.array_min(periods).alias("first_period"), F.array_max(periods).alias("last_period"), reason.alias("reason"))


def global_instruments(payloads: DataFrame) -> DataFrame:
    """Global indices and indicators with ``reason``: another segment, a key that does not begin with it, no symbol, or a repeated key."""
    kind = "array<struct<segment:string,instrument_key:string,trading_symbol:string,name:string,exchange:string>>"
    rows = payloads.select(F.explode(F.from_json("body", kind)).alias("r")).select("r.*")
    n = rows.groupBy("instrument_key").agg(F.count("*").alias("_n"))
    reason = F.when(~F.coalesce(F.col("segment").isin(*GLOBAL_SEGMENTS), F.lit(False)), "NOT_GLOBAL").when(~F.col("instrument_key").startswith(F.concat("segment", F.lit("|"))) | (F.coalesce("trading_symbol", F.lit("")) == ""), "MALFORMED_KEY").when(F.col("_n") > 1, "DUPLICATE_KEY")
    return rows.join(n, "instrument_key").select("instrument_key", "segment", "exchange", "trading_symbol", F.nullif("name", F.lit("")).alias("name"), reason.alias("reason"))


def announcements(items: DataFrame) -> DataFrame:
    """Exchange announcements (title, link, description, published_at, reason): with id, subject, and the symbol in the attachment's name."""
    sid = F.coalesce("link", stable_id(F.col("title"), F.col("description"), F.col("published_at").cast("string")))
    none = lambda c: F.nullif(c, F.lit(""))
    why = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "MALFORMED_ITEM").otherwise(F.col("reason"))
    rows = items.select(sid.alias("source_id"), F.trim("title").alias("title"), "link", "published_at", none(F.regexp_extract(F.coalesce("description", F.lit("")), SUBJECT, 1)).alias("subject"), none(F.regexp_extract(F.coalesce("link", F.lit("")), SYMBOL_IN_FILE, 1)).alias("symbol"), why.alias("reason"))
    # of rows of one id the earliest stands; rows that are equal in all else are one
    rest = ["published_at", *[c for c in rows.columns if c not in ("source_id", "published_at")]]
    first = rows.groupBy("source_id").agg(F.min(F.struct(F.col("published_at").isNull().alias("_undated"), *rest)).alias("_first"))
    return first.select("source_id", "_first.*").select(*rows.columns)


def event_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of dated events: ``day, event``, with a reason where the date is bad."""
    raw = spark.read.schema("date string, event string").option("header", True).option("enforceSchema", False).csv(path)
    day = F.try_to_date("date", "yyyy-MM-dd")
    return raw.select(day.alias("day"), F.trim("event").alias("event"), F.when(day.isNull(), "BAD_DATE").alias("reason"))
