"""Vendor payloads to typed rows.

Payloads are read as whole texts (one per file or row), parsed by declared schemas, and
split into good rows and rows with a reason; nothing is inferred and nothing dropped
silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import on_grid, parse_number


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, body``: every file's text with the digest of its bytes (gz is read through)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.sha2("value", 256).alias("sha256"), F.col("value").alias("body"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """``sha256, bytes``: content-addressed raw payloads; equal bytes are one row."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.first("content").alias("bytes"), F.min("modificationTime").alias("first_seen"))


def candles(payloads: DataFrame, minutes: int = 1) -> DataFrame:
    """Candle payloads to rows with ``reason`` (null for good ones).

    ``payloads``: key, fetched_at, session_open, body, where body is {"status", "data": {"candles": [[start, o, h, l, c, v, oi], ...]}}.
    A candle that occurs twice with equal values counts once; with differing values none
    of them is good.
    """
    parsed = F.from_json("body", "struct<status:string,data:struct<candles:array<array<string>>>>")
    rows = payloads.select("key", "fetched_at", "session_open", parsed.alias("_p"))
    bad = rows.where(F.col("_p.data.candles").isNull()).select("key", F.lit(None).cast("timestamp").alias("start"), *[F.lit(None).cast("decimal(18,6)").alias(c) for c in ("open", "high", "low", "close")], F.lit(None).cast("decimal(22,0)").alias("volume"), F.lit("MALFORMED_PAYLOAD").alias("reason"))
    each = rows.select("key", "fetched_at", "session_open", F.explode("_p.data.candles").alias("_c"))
    number = lambda i, kind: F.get("_c", F.lit(i)).try_cast(kind)
    each = each.select(
        "key", "fetched_at", "session_open", F.size("_c").alias("_n"), F.try_to_timestamp(F.get("_c", F.lit(0))).alias("start"),
        *[number(i, "decimal(18,6)").alias(c) for i, c in enumerate(("open", "high", "low", "close"), 1)], number(5, "decimal(22,0)").alias("volume"),
    )
    prices = F.least("open", "high", "low", "close")
    absent = F.exists(F.array("open", "high", "low", "close", "volume"), lambda x: x.isNull())
    values = F.struct("open", "high", "low", "close", "volume")
    # values differ where the least and the greatest do: no distinct ones are kept
    counted = each.groupBy("key", "start").agg((~F.min(values).eqNullSafe(F.max(values))).alias("_differ"), *[F.min(c).alias(c) for c in ("fetched_at", "session_open", "_n")], F.min(values).alias("_x")).select("*", "_x.*").drop("_x")
    reason = (
        F.when((F.col("_n") < 6) | F.col("start").isNull() | absent, "MALFORMED_ROW")
        .when(F.col("_differ"), "CONFLICTING_DUPLICATE")
        .when(prices <= 0, "NON_POSITIVE_PRICE")
        .when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), "OHLC_INCONSISTENT")
        .when(F.col("volume") < 0, "NEGATIVE_VOLUME")
        .when(F.col("start") > F.col("fetched_at"), "AFTER_FETCH")
        .when(~on_grid(F.col("start"), F.col("session_open"), F.lit(minutes)), "OFF_GRID")
    )
    good = counted.select("key", "start", "open", "high", "low", "close", "volume", reason.alias("reason"))
    return good.unionByName(bad)


def instruments(payloads: DataFrame) -> DataFrame:
    """An instrument master (a JSON array) to rows with ``reason``: the first of equal keys stays, a differing repeat is refused."""
    kind = "array<struct<instrument_key:string,segment:string,name:string,isin:string,lot_size:int>>"
    rows = payloads.select(F.posexplode(F.from_json("body", kind)).alias("_i", "r")).select("_i", "r.*")
    shape = F.struct("segment", "name", "isin", "lot_size")
    grouped = rows.groupBy("instrument_key").agg(F.min_by(shape, "_i").alias("s"), F.count_distinct(shape).alias("_v"))
    reason = (
        F.when(F.col("instrument_key").isNull() | ~F.col("instrument_key").contains("|"), "MALFORMED_KEY")
        .when(F.split_part("instrument_key", F.lit("|"), F.lit(1)) != F.col("segment"), "SEGMENT_MISMATCH")
        .when(F.col("_v") > 1, "CONFLICTING_DUPLICATE")
    )
    return grouped.select("instrument_key", "s.*", "_v").select("instrument_key", "segment", "name", "isin", "lot_size", reason.alias("reason"))


def corporate_actions(payloads: DataFrame) -> DataFrame:
    """Name/value pairs of corporate events to typed rows with a content hash."""
    kind = "array<struct<type:string,details:array<struct<name:string,value:string>>>>"
    rows = payloads.select("key", "fetched_at", F.explode(F.from_json("body", kind)).alias("e"))
    pairs = F.map_from_entries(F.transform("e.details", lambda d: F.struct(F.lower(d["name"]), d["value"])))
    rows = rows.withColumn("_m", pairs)
    ratio = F.regexp_extract(F.col("_m")["ratio"], r"^(\d+)\s*:\s*(\d+)$", 1), F.regexp_extract(F.col("_m")["ratio"], r"^(\d+)\s*:\s*(\d+)$", 2)
    return rows.select(
        "key",
        F.upper("e.type").alias("action_type"),
        F.try_to_date(F.col("_m")["ex date"], "d MMM yyyy").alias("ex_date"),
        ratio[0].try_cast("int").alias("ratio_new"),
        ratio[1].try_cast("int").alias("ratio_old"),
        parse_number(F.col("_m")["amount"]).alias("amount"),
        F.sha2(F.to_json("e"), 256).alias("content_hash"),
        "fetched_at",
    )


def flows(payloads: DataFrame) -> DataFrame:
    """Wide institutional flows to a long series: ``series_code, day, value``."""
    rows = payloads.select("side", "interval", F.explode(F.from_json("body", "array<struct<day:string,segment:string,buy_amt:string,sell_amt:string>>")).alias("r"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("v")) for f in ("buy_amt", "sell_amt")])
    long = rows.select("side", "interval", F.col("r.segment").alias("segment"), F.try_to_date("r.day", "yyyy-MM-dd").alias("day"), F.inline(pairs))
    return long.select(F.concat_ws("|", "side", "segment", F.lit("CASH"), "interval", "field").alias("series_code"), "day", parse_number(F.col("v")).alias("value"))


def news_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """RSS items or sitemap entries (``row_tag`` ``url``) as rows: title, link, published_at, and a reason where the time is bad."""
    schema = "title string, link string, loc string, guid string, pubDate string, description string"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    formats = ("EEE, dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd MMM, yyyy Z")
    without_day = F.regexp_replace("pubDate", r"^[A-Za-z]{3},\s*", "")
    at = F.coalesce(F.try_to_timestamp(without_day, F.lit("dd MMM yyyy HH:mm:ss Z")), *[F.try_to_timestamp(F.col("pubDate"), F.lit(f)) for f in formats[1:]])
    return raw.select("title", F.coalesce("link", "loc").alias("link"), "guid", "description", at.alias("published_at"), F.when(at.isNull(), "BAD_TIMESTAMP").alias("reason"))


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A results calendar in CSV: header synonyms to canonical names; a file that lacks one is refused."""
    synonyms = {"symbol": ("symbol", "ticker", "nse symbol"), "company": ("company", "company name", "name"), "meeting_date": ("date", "meeting date", "result date")}
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower(): c for c in raw.columns}
    picked = {name: next((by[s] for s in names if s in by), None) for name, names in synonyms.items()}
    if missing := [n for n, c in picked.items() if c is None]:
        raise ValueError(f"no column for {missing}")
    date = F.coalesce(*[F.try_to_date(F.col(f"`{picked['meeting_date']}`"), f) for f in ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy")])
    return raw.select(F.trim(F.col(f"`{picked['symbol']}`")).alias("symbol"), F.trim(F.col(f"`{picked['company']}`")).alias("company"), date.alias("meeting_date"), F.when(date.isNull(), "BAD_DATE").alias("reason"))


def bhavcopy(spark: SparkSession, path: str, day: str) -> DataFrame:
    """An official daily price file as bars of one day."""
    schema = "SYMBOL string, SERIES string, OPEN double, HIGH double, LOW double, CLOSE double, TOTTRDQTY long"
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return raw.where("SERIES = 'EQ'").select(F.concat(F.lit("NSE_EQ|"), F.trim("SYMBOL")).alias("key"), F.to_date(F.lit(day)).alias("day"), F.col("OPEN").alias("open"), F.col("HIGH").alias("high"), F.col("LOW").alias("low"), F.col("CLOSE").alias("close"), F.col("TOTTRDQTY").alias("volume"))


def article_text(html: Column) -> Column:
    """The readable text of a page: scripts, styles and comments out, tags to spaces, entities resolved."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head|nav|footer)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drift(payloads: DataFrame, body: str, expected: set[str]) -> DataFrame:
    """Top-level JSON keys that are not declared, with how many payloads have them."""
    keys = payloads.select(F.explode(F.json_object_keys(body)).alias("field"))
    return keys.where(~F.col("field").isin(*expected)).groupBy("field").agg(F.count("*").alias("payloads"))
