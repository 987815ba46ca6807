"""News operators: normalisation, duplicate decisions, scope, assessment, windows of counts, stories."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.reasons import DIVISION_UNDEFINED, MISSING_INPUT, NOT_APPLICABLE, result
from ..functions.scalars import crore_amount
from .alike import candidates, of_pairs, stored
from .newsrules import CORRECTION

# The vocabularies of the rules.
CORPORATE_EVENTS = ("RESULTS", "EARNINGS", "GUIDANCE", "DIVIDEND", "BONUS", "SPLIT", "BUYBACK", "FUNDRAISING", "MERGER_ACQUISITION", "DEMERGER", "STAKE_SALE", "BLOCK_DEAL", "PROMOTER_CHANGE", "MANAGEMENT_CHANGE", "ORDER_CONTRACT", "RATING_CHANGE", "DEFAULT", "BANKRUPTCY", "DEBT", "CORPORATE_ACTION", "FRAUD_ALLEGATION", "LITIGATION")
REGULATORY_EVENTS = ("REGULATORY", "INVESTIGATION")
MACRO_EVENTS = ("INTEREST_RATE", "INFLATION", "GDP", "FII_DII", "MACRO", "GOVERNMENT_POLICY")
MACRO_MENTIONS = ("CENTRAL_BANK", "MACRO_INDICATOR", "BOND_YIELD", "GOVERNMENT")
GLOBAL_WORDS = r"(?i)\b(wall st(reet)?|dow( jones)?|nasdaq|s&p( 500)?|nikkei|hang seng|kospi|ftse|dax|shanghai composite|asian (markets?|stocks|shares|peers)|global (markets?|stocks|cues|equities)|european (markets?|stocks)|us (markets?|stocks|equities))\b"
CORPORATE_WORDS = r"(?i)\b(ipos?|listing|lists|debut|gmp|bags|wins|order|orders|contract|appoints?|appointed|resigns?|ceo|cfo|acquires?|acquisition|merger|stake|buyback|dividend|fund ?raise|raises|qip|results|q[1-4]|net profit|revenue)\b"
MARKET_WORDS = r"(?i)\b(stocks?|shares?|equit(y|ies)|markets?|trade setup|pre-market|opening bell|investors?|mutual funds?|sips?|etfs?|bonds?|yields?|brokerages?|target price|rally|sell-?off|dalal street|d-street|indices|gainers|losers|breadth|straight session)\b"
POSITIVE_WORDS = r"(?i)\b(rise|rises|rose|jump|jumps|jumped|surge|surges|surged|soar|soars|rally|rallies|gain|gains|gained|climb|climbs|upgrade|upgrades|beats?|record high|52-week high|wins?|bags?|approves?|approval|profit rises)\b"
NEGATIVE_WORDS = r"(?i)\b(fall|falls|fell|drop|drops|dropped|slump|slumps|plunge|plunges|tumble|tumbles|crash|crashes|slide|slides|sink|sinks|decline|declines|downgrade|downgrades|miss|misses|loss|losses|52-week low|lower circuit|default|probe|penalty|fraud|sell-off|selloff)\b"
NEUTRAL_WORDS = r"(?i)\b(unchanged|flat|steady|holds)\b"
BREAKING_WORDS = r"(?i)\b(breaking|just in)\b"
HIGH_IMPACT = ("RESULTS", "MERGER_ACQUISITION", "DEMERGER", "BANKRUPTCY", "DEFAULT", "FRAUD_ALLEGATION", "INVESTIGATION", "RATING_CHANGE", "INTEREST_RATE")
MEDIUM_IMPACT = ("ORDER_CONTRACT", "FUNDRAISING", "DIVIDEND", "BONUS", "SPLIT", "BUYBACK", "MANAGEMENT_CHANGE", "BROKERAGE_ACTION", "STAKE_SALE", "BLOCK_DEAL", "PROMOTER_CHANGE", "COMMODITIES", "FII_DII", "INFLATION", "GDP", "REGULATORY", "GOVERNMENT_POLICY", "LITIGATION", "MARKET_WIDE", "GEOPOLITICAL", "GUIDANCE", "CORPORATE_ACTION", "DEBT")
SIZED_EVENTS = ("ORDER_CONTRACT", "FUNDRAISING", "MERGER_ACQUISITION", "STAKE_SALE")
STOP_WORDS = (
    "a an the of in on at to for and or as by with from is are was were be be its it this that after before over under amid into up down new says said may will could "
    "shares share stock stocks today live updates update news report reports rs crore cr lakh per cent percent here what why how check key"
).split()


@F.pandas_udf(StringType())
def compatible_title(titles: pd.Series) -> pd.Series:
    """Compatibility forms and full case folding, which Spark has no function for."""
    squeeze = re.compile(r"[\W_]+")
    return titles.map(lambda t: None if t is None else squeeze.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip())


def _earliest_before(items: DataFrame, key: str, span: int) -> DataFrame:
    """``item_id, first_id``: each item's earliest predecessor of its source and key within ``span`` microseconds, if there is one.

    Every item asks at the start of its window; items and questions lie in one descending
    order and the item met last is carried along, so a text that is repeated often costs a
    row each, not its whole window.
    """
    own = items.where(F.col(key).isNotNull()).select("source", F.col(key).alias("_k"), "_t", "item_id")
    seen = own.select("source", "_k", F.col("_t").alias("_at"), F.lit(1).alias("_side"), "item_id", F.struct("_t", "item_id").alias("_row"), F.lit(None).cast("long").alias("_asked"))
    asks = own.select("source", "_k", (F.col("_t") - span).alias("_at"), F.lit(0).alias("_side"), "item_id", F.lit(None).cast(seen.schema["_row"].dataType).alias("_row"), F.col("_t").alias("_asked"))
    w = Window.partitionBy("source", "_k").orderBy(F.desc("_at"), F.desc("_side"), F.desc("item_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = seen.unionByName(asks).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_side = 0 AND _row._t < _asked")
    return met.select("item_id", F.col("_row.item_id").alias("first_id"))


def duplicates(items: DataFrame, window_hours: int = 24) -> DataFrame:
    """Decides each article against earlier ones of its source: ``item_id, decision, rule, related_id``.

    ``items``: item_id, source, url, title_hash, content_hash, at.  The rules URL, CONTENT and
    TITLE apply in that order; the earliest match within the window is the related one.
    """
    timed = items.withColumn("_t", F.unix_micros(F.col("at").cast("timestamp")))
    found = timed.select("item_id")
    rules = {"SAME_SOURCE_URL": "url", "SAME_SOURCE_CONTENT": "content_hash", "SAME_SOURCE_TITLE": "title_hash"}
    for rule, key in rules.items():
        found = found.join(_earliest_before(timed, key, window_hours * 3_600_000_000).withColumnRenamed("first_id", rule), "item_id", "left")
    rule = F.coalesce(*[F.when(F.col(r).isNotNull(), r) for r in rules], F.lit("FIRST_SEEN"))
    return found.select("item_id", F.when(rule == "FIRST_SEEN", "NEW_ARTICLE").otherwise("DUPLICATE_ARTICLE").alias("decision"), rule.alias("rule"), F.coalesce(*[F.col(r) for r in rules]).alias("related_id"))


def edits(observations: DataFrame, material: tuple[str, ...] = ("title", "summary", "body")) -> DataFrame:
    """What changed between consecutive observations of an article: ``item_id, at, changed, decision``."""
    w = Window.partitionBy("item_id").orderBy("at")
    changed = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(w)), c) for c in material]))
    correction = CORRECTION
    marked = F.col("title").rlike(correction) & ~F.coalesce(F.lag("title").over(w).rlike(correction), F.lit(False))
    o = observations.withColumns({"_n": F.row_number().over(w), "changed": changed, "_m": marked})
    decision = F.when(F.array_contains("changed", "title") & F.col("_m"), "STORY_CORRECTION").otherwise("STORY_UPDATE")
    return o.where((F.col("_n") > 1) & (F.size("changed") > 0)).select("item_id", "at", "changed", decision.alias("decision"))


def scope(items: DataFrame) -> DataFrame:
    """Adds ``scope``, ``other_scopes`` and ``confidence`` by ordered rules.

    ``items``: title, category, n_companies, mention_types (array), source_kind.  The first rule
    that holds is primary; a vocabulary decides when none does.
    """
    has = lambda *types: F.arrays_overlap("mention_types", F.array(*[F.lit(t) for t in types]))
    cat, none = F.col("category"), F.col("n_companies") == 0
    rules = (
        ("REGULATORY", cat.isin(*REGULATORY_EVENTS) | (F.col("source_kind") == "REGULATOR") | (none & has("REGULATOR", "COURT"))),
        ("CORPORATE", cat.isin(*CORPORATE_EVENTS)),
        ("COMPANY", ~none & ~cat.isin(*CORPORATE_EVENTS)),
        ("GEOPOLITICAL", (cat == "GEOPOLITICAL") | has("GEOPOLITICAL")),
        ("CURRENCY", has("CURRENCY")),
        ("COMMODITY", (cat == "COMMODITIES") | has("COMMODITY")),
        ("MACRO", cat.isin(*MACRO_EVENTS) | has(*MACRO_MENTIONS)),
        ("GLOBAL_MARKET", F.col("title").rlike(GLOBAL_WORDS)),
        ("SECTOR", (cat == "SECTOR_EVENT") | has("SECTOR")),
        ("MARKET_WIDE", (cat == "MARKET_WIDE") | has("INDEX", "EXCHANGE")),
    )
    hits = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))
    vocabulary = F.when(F.col("source_kind") == "EXCHANGE", "CORPORATE").when(F.col("title").rlike(CORPORATE_WORDS), "CORPORATE").when(F.col("title").rlike(MARKET_WORDS), "MARKET_WIDE").otherwise("IRRELEVANT")
    strong = (cat != "OTHER") | ~none | (F.col("source_kind") == "REGULATOR")
    items = items.withColumn("_hits", hits)
    some = F.size("_hits") > 0
    primary = F.coalesce(F.try_element_at("_hits", F.lit(1)), vocabulary)
    confidence = F.when(some & strong, 0.8).when(some, 0.6).when(primary == "IRRELEVANT", 0.3).otherwise(0.5)
    return items.withColumns({"scope": primary, "other_scopes": F.when(some, F.slice("_hits", 2, 10)).otherwise(F.slice("_hits", 1, 0)), "confidence": confidence}).drop("_hits")


def direction(title: Column) -> Column:
    """POSITIVE, NEGATIVE, MIXED, NEUTRAL or UNKNOWN by the words of a headline."""
    up, down = title.rlike(POSITIVE_WORDS), title.rlike(NEGATIVE_WORDS)
    return F.when(up & down, "MIXED").when(up, "POSITIVE").when(down, "NEGATIVE").when(title.rlike(NEUTRAL_WORDS), "NEUTRAL").otherwise("UNKNOWN")


def impact(title: Column, category: Column, n_companies: Column) -> Column:
    """HIGH, MEDIUM, LOW or UNKNOWN: the category's weight, raised by large sums and large single-stock moves."""
    base = F.when(category.isin(*HIGH_IMPACT), "HIGH").when(category.isin(*MEDIUM_IMPACT), "MEDIUM").when(n_companies > 0, "LOW").otherwise("UNKNOWN")
    moves = F.transform(F.regexp_extract_all(title, F.lit(r"(\d+(?:\.\d+)?)\s?%"), F.lit(1)), lambda x: x.cast("double"))
    large = (category.isin(*SIZED_EVENTS) & (crore_amount(title) >= 1000)) | ((n_companies > 0) & (F.array_max(moves) >= 5))
    return F.when(F.coalesce(large, F.lit(False)), "HIGH").otherwise(base)


def breaking(title: Column, impact_: Column, published: Column, discovered: Column, backlog: Column) -> Column:
    """Labelled so by its source, or a HIGH item found live within a quarter of an hour."""
    lag = F.unix_micros(discovered.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))
    live = ~backlog & (impact_ == "HIGH") & lag.between(0, 900_000_000)
    return title.rlike(BREAKING_WORDS) | F.coalesce(live, F.lit(False))


WINDOWS = {"1h": 1, "4h": 4, "24h": 24, "3d": 72}


def news_counts(items: DataFrame, instant: Column, covered: Column, by: list[str] = ()) -> DataFrame:
    """Counts of the news that was knowable in the windows before an instant, as (value, reason) structs.

    ``items``: item_id, publisher, story_id, direction, is_breaking, knowable_at.  Without coverage a
    count is MISSING_INPUT: 0 is a value only where collection is proven.
    """
    age = (F.unix_micros(instant.cast("timestamp")) - F.unix_micros(F.col("knowable_at").cast("timestamp"))) / 3.6e9
    seen = items.where(F.col("knowable_at") < instant).withColumn("_age", age)
    inside = lambda h: F.col("_age") <= h
    missing = (~covered, MISSING_INPUT)
    day = inside(24)
    n = {k: F.count_if(inside(h)) for k, h in WINDOWS.items()}
    out = {f"news_count_{k}": result(c.cast("double"), missing) for k, c in n.items()}
    out["unique_publishers_24h"] = result(F.count_distinct(F.when(day, F.col("publisher"))).cast("double"), missing)
    out["story_count_24h"] = result(F.count_distinct(F.when(day, F.col("story_id"))).cast("double"), missing)
    for name in ("POSITIVE", "NEGATIVE", "MIXED"):
        out[f"{name.lower()}_count_24h"] = result(F.count_if(day & (F.col("direction") == name)).cast("double"), missing)
    out["breaking_count_24h"] = result(F.count_if(day & F.col("is_breaking")).cast("double"), missing)
    rest = F.count_if(day & (F.col("_age") > 1)) / 23
    out["velocity_1h"] = result(F.try_divide(n["1h"], rest), missing, (rest == 0, DIVISION_UNDEFINED))
    out["publisher_diversity_24h"] = result(F.try_divide(F.count_distinct(F.when(day, F.col("publisher"))), n["24h"]), missing, (n["24h"] == 0, DIVISION_UNDEFINED))
    out["seconds_since_last"] = result(F.min("_age") * 3600, missing, (F.min("_age").isNull(), NOT_APPLICABLE))
    score = F.when(F.col("direction") == "POSITIVE", 1.0).when(F.col("direction") == "NEGATIVE", -1.0).otherwise(0.0)
    out["sentiment_24h"] = result(F.avg(F.when(day, score)), missing, (n["24h"] == 0, NOT_APPLICABLE))
    return seen.groupBy(*by).agg(*[c.alias(k) for k, c in out.items()])


def title_words(title: Column) -> Column:
    """The distinct words of a title that carry meaning."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " ")), " "))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS) & ~w.rlike(r"^\d+$"))


def similar_pairs(items: DataFrame, least: float = 0.7, hours: int = 3) -> DataFrame:
    """``item_id, earlier_id, jaccard``: each item with its best earlier one of similar words inside the window.

    Items meet over the rarest of their words within slots of time (:mod:`.alike`), and only
    those that share several are compared.
    """
    span = hours * 3600
    base = stored(items.select("item_id", F.unix_timestamp(F.col("at").cast("timestamp")).alias("t"), title_words(F.col("title")).alias("words")).where(F.size("words") > 0), "titles")
    pairs = candidates(base, least, span)
    base = of_pairs(base, pairs)
    a, b = (base.select(F.col("item_id").alias(f"{p}_id"), F.col("t").alias(f"_t{p}"), F.col("words").alias(f"_w{p}")) for p in "ab")
    met = pairs.join(a, "a_id").join(b, "b_id").withColumn("_both", F.size(F.array_intersect("_wa", "_wb")))
    later = F.struct("_tb", "b_id") > F.struct("_ta", "a_id")
    scored = met.select(
        F.when(later, F.col("b_id")).otherwise(F.col("a_id")).alias("item_id"), F.when(later, F.col("a_id")).otherwise(F.col("b_id")).alias("earlier_id"),
        (F.col("_both") / (F.size("_wa") + F.size("_wb") - F.col("_both"))).alias("jaccard"),
    ).where(F.col("jaccard") >= least)
    return scored.groupBy("item_id").agg(F.max_by(F.struct("earlier_id", "jaccard"), F.struct("jaccard", -F.col("earlier_id"))).alias("m")).select("item_id", "m.earlier_id", F.round("m.jaccard", 6).alias("jaccard"))


def story_view(members: DataFrame) -> DataFrame:
    """One row per story: members, publishers, first and last article, whether any is breaking."""
    return members.groupBy("story_id").agg(
        F.count("*").alias("members"), F.array_sort(F.collect_set("publisher")).alias("publishers"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.max_by("title", F.struct("at", "item_id")).alias("latest_title"), F.bool_or("is_breaking").alias("is_breaking"),
    )
