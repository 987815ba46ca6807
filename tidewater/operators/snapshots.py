"""Snapshot features beyond bars: news families, pre-open auction, events, flows, context, and reads behind screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reasons import DIVISION_UNDEFINED, MISSING_INPUT, NOT_APPLICABLE, result
from .news import CORPORATE_EVENTS, MACRO_EVENTS, REGULATORY_EVENTS, WINDOWS
from .pit import latest_by

#: Scope names of the counts by scope.
SCOPES = {"market_wide": "MARKET_WIDE", "macro_scope": "MACRO", "geopolitical": "GEOPOLITICAL", "commodity": "COMMODITY", "currency": "CURRENCY", "global_market": "GLOBAL_MARKET"}


def _age(instant: Column, at: str) -> Column:
    """Hours from a row's time to the instant."""
    return (F.unix_micros(instant.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 3.6e9


def market_news(items: DataFrame, instant: Column, covered: Column, by: list[str] = ()) -> DataFrame:
    """All market-wide news features at an instant, each a (value, reason) struct.

    ``items``: item_id, publisher, source, story_id, story_founder (bool), category, scope, direction,
    impact, is_breaking, is_correction, is_edited, is_duplicate, knowable_at.  Duplicates
    only count in ``duplicate_count_24h``.  Without coverage every feature is
    MISSING_INPUT.  One aggregation with map-side combination, distinct counts aside.
    """
    seen = items.where(F.col("knowable_at") < instant).withColumn("_age", _age(instant, "knowable_at"))
    missing = (~covered, MISSING_INPUT)
    live = ~F.col("is_duplicate")
    inside = lambda h: live & (F.col("_age") <= h)
    day, number = inside(24), lambda c: result(c.cast("double"), missing)
    n = {k: F.count_if(inside(h)) for k, h in WINDOWS.items()}
    distinct = lambda when, column: F.count_distinct(F.when(when, F.col(column)))
    out = {f"news_count_{k}": number(c) for k, c in n.items()}
    out |= {"unique_publishers_1h": number(distinct(inside(1), "publisher")), "unique_publishers_24h": number(distinct(day, "publisher")), "unique_sources_24h": number(distinct(day, "source"))}
    flags = {
        "breaking_news": F.col("is_breaking"), "high_relevance_news": F.col("impact") == "HIGH", "negative_news": F.col("direction") == "NEGATIVE", "positive_news": F.col("direction") == "POSITIVE",
        "mixed_news": F.col("direction") == "MIXED", "regulatory_news": F.col("category").isin(*REGULATORY_EVENTS), "corporate_news": F.col("category").isin(*CORPORATE_EVENTS), "macro_news": F.col("category").isin(*MACRO_EVENTS),
    }
    flags |= {f"{k}_news": F.col("scope") == v for k, v in SCOPES.items()}
    flags |= {"correction": F.col("is_correction"), "edited_news": F.col("is_edited")}
    out |= {f"{k}_count_24h": number(F.count_if(day & c)) for k, c in flags.items()}
    out["duplicate_count_24h"] = number(F.count_if(F.col("is_duplicate") & (F.col("_age") <= 24)))
    hour_before, days_before = F.count_if(day & (F.col("_age") > 1)) / 23, F.count_if(inside(72) & (F.col("_age") > 24)) / 2
    out["news_velocity_1h"] = result(F.try_divide(n["1h"], hour_before), missing, (hour_before == 0, DIVISION_UNDEFINED))
    out["news_velocity_24h"] = result(F.try_divide(n["24h"], days_before), missing, (days_before == 0, DIVISION_UNDEFINED))
    out["publisher_diversity_24h"] = result(F.try_divide(distinct(day, "publisher"), n["24h"]), missing, (n["24h"] == 0, DIVISION_UNDEFINED))
    stories, founded = distinct(day, "story_id"), distinct(day & F.col("story_founder"), "story_id")
    out |= {"story_group_count_24h": number(stories), "new_story_count_24h": number(founded), "updated_story_count_24h": number(stories - founded)}
    since = lambda when: F.min(F.when(when, F.col("_age"))) * 3600
    high = live & (F.col("impact") == "HIGH")
    out["time_since_last_news_s"] = result(since(live), missing, (since(live).isNull(), NOT_APPLICABLE))
    out["time_since_last_high_relevance_news_s"] = result(since(high), missing, (since(high).isNull(), NOT_APPLICABLE))
    return seen.groupBy(*by).agg(*[c.alias(k) for k, c in out.items()])


def company_news(links: DataFrame, keys: DataFrame, instant: Column, covered: Column) -> DataFrame:
    """News features of every key, a proven 0 where none is linked.

    ``links``: key, item_id, story_id, direction, is_correction, knowable_at; ``keys``: key.
    Sentiment is the mean direction of the window, NOT_APPLICABLE without an article.
    """
    seen = links.where(F.col("knowable_at") < instant).withColumn("_age", _age(instant, "knowable_at"))
    inside = lambda h: F.col("_age") <= h
    score = F.when(F.col("direction") == "POSITIVE", 1.0).when(F.col("direction") == "NEGATIVE", -1.0).otherwise(0.0)
    raw = seen.groupBy("key").agg(
        *[F.count_if(inside(h)).alias(f"_n_{k}") for k, h in WINDOWS.items()], F.count_distinct(F.when(inside(24), F.col("story_id"))).alias("_stories"), F.count_if(inside(24) & F.col("is_correction")).alias("_corrections"),
        F.min("_age").alias("_last"), F.avg(F.when(inside(24), score)).alias("_s24"), F.avg(F.when(inside(72), score)).alias("_s72"),
    )
    every = keys.select("key").distinct().join(raw, "key", "left")
    missing = (~covered, MISSING_INPUT)
    count = lambda c: result(F.coalesce(F.col(c), F.lit(0)).cast("double"), missing)
    absent = lambda c: result(F.col(c), missing, (F.col(c).isNull(), NOT_APPLICABLE))
    return every.select(
        "key", *[count(f"_n_{k}").alias(f"company_count_{k}") for k in WINDOWS], count("_stories").alias("company_story_count_24h"), count("_corrections").alias("company_correction_count_24h"),
        result(F.col("_last") * 3600, missing, (F.col("_last").isNull(), NOT_APPLICABLE)).alias("company_time_since_last_s"), absent("_s24").alias("company_sentiment_24h"), absent("_s72").alias("company_sentiment_3d"),
    )


def preopen(ticks: DataFrame, context: DataFrame) -> DataFrame:
    """Pre-open auction features of each key's last tick.

    ``ticks``: key, at, seq, price, bid, ask, quantity; ``context``: key, previous_close, average_volume.
    """
    last = latest_by(ticks, ["key"], ["at", "seq"])
    b = context.join(last, "key", "left")
    none = (F.col("at").isNull(), MISSING_INPUT)
    depth = F.col("bid") + F.col("ask")
    return b.select(
        "key",
        result(F.try_divide("price", "previous_close") - 1, none, (F.col("price").isNull() | F.col("previous_close").isNull(), MISSING_INPUT), (F.col("previous_close") <= 0, DIVISION_UNDEFINED)).alias("preopen_gap_pct"),
        result(F.try_divide(F.col("bid") - F.col("ask"), depth), none, (depth.isNull(), MISSING_INPUT), (depth == 0, DIVISION_UNDEFINED)).alias("preopen_imbalance"),
        result(F.col("quantity").cast("double"), none, (F.col("quantity").isNull(), MISSING_INPUT)).alias("preopen_ieq"),
        result(F.try_divide("quantity", "average_volume"), none, (F.col("quantity").isNull() | F.col("average_volume").isNull(), MISSING_INPUT), (F.col("average_volume") <= 0, DIVISION_UNDEFINED)).alias("preopen_ieq_to_avg_volume"),
    )


def days_since_action(actions: DataFrame, keys: DataFrame, session: Column, kinds: dict[str, list[str]]) -> DataFrame:
    """Days since each key's latest ex-date on or before the session, per family of action types (``any`` takes all)."""
    past = actions.where(F.col("ex_date") <= session)
    aggs = {name: F.max(F.when(F.lit(not types) | F.col("action_type").isin(*(types or [""])), F.col("ex_date"))) for name, types in kinds.items()}
    raw = past.groupBy("key").agg(*[c.alias(f"_{k}") for k, c in aggs.items()])
    every = keys.select("key").distinct().join(raw, "key", "left")
    return every.select("key", *[result(F.datediff(session, F.col(f"_{k}")).cast("double"), (F.col(f"_{k}").isNull(), NOT_APPLICABLE)).alias(f"ca_days_since_{k}") for k in kinds])


def result_events(events: DataFrame, keys: DataFrame, session: Column, covered: Column, least_days: int = 120) -> DataFrame:
    """Features of results meetings and outcomes.

    ``events``: key, kind (INTIMATION, OUTCOME), period_end, day, event_id, known_at.  Of several
    intimations of one period the last known holds; ``covered`` is the number of days that
    the collection reaches back (null without).
    """
    planned = latest_by(events.where("kind = 'INTIMATION'").select("key", "period_end", "known_at", "event_id", "day"), ["key", "period_end"], ["known_at", "event_id"])
    ahead = planned.groupBy("key").agg(F.min(F.when(F.col("day") >= session, F.col("day"))).alias("_next"), F.bool_or(F.col("day") == session).alias("_today"))
    done = events.where(F.col("kind") == "OUTCOME").where(F.col("day") <= session).groupBy("key").agg(F.max("day").alias("_last"))
    b = keys.select("key").distinct().join(ahead, "key", "left").join(done, "key", "left")
    missing = (covered.isNull(), MISSING_INPUT)
    return b.select(
        "key",
        result(F.datediff("_next", session).cast("double"), missing, (F.col("_next").isNull(), NOT_APPLICABLE)).alias("results_days_to_next"),
        result(F.coalesce("_today", F.lit(False)).cast("double"), missing).alias("results_today"),
        result(F.datediff(session, "_last").cast("double"), missing, (F.col("_last").isNull() & (covered < least_days), MISSING_INPUT), (F.col("_last").isNull(), NOT_APPLICABLE)).alias("results_days_since"),
    )


def analyst_counts(headlines: DataFrame, keys: DataFrame, instant: Column, covered: Column, days: int = 30) -> DataFrame:
    """Upgrades and downgrades per key within the window: headlines that are linked to exactly one company.

    ``headlines``: item_id, key, action (UP, DOWN or null), knowable_at.
    """
    single = headlines.groupBy("item_id").agg(F.count_distinct("key").alias("_c"), F.min("key").alias("key"), F.min("action").alias("action"), F.min("knowable_at").alias("knowable_at")).where("_c = 1")
    inside = single.where((F.col("knowable_at") < instant) & (_age(instant, "knowable_at") <= days * 24))
    n = inside.groupBy("key").agg(F.count_if(F.col("action") == "UP").alias("_u"), F.count_if(F.col("action") == "DOWN").alias("_d"))
    b = keys.select("key").distinct().join(n, "key", "left")
    count = lambda c: result(F.coalesce(F.col(c), F.lit(0)).cast("double"), (~covered, MISSING_INPUT))
    return b.select("key", count("_u").alias("analyst_upgrades_30d"), count("_d").alias("analyst_downgrades_30d"))


def confirmed_return(labels: DataFrame, instant: Column) -> DataFrame:
    """``key, global_ret_1d``: return between each key's last two labels that were confirmed before the instant."""
    w = Window.partitionBy("key").orderBy(F.desc("day"))
    seen = labels.where((F.col("state") == "CONFIRMED") & (F.col("confirmed_at") < instant)).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    two = seen.groupBy("key").agg(F.max(F.when(F.col("_n") == 1, F.col("close"))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col("close"))).alias("_b"))
    return two.select("key", result(F.try_divide("_a", "_b") - 1, (F.col("_b").isNull(), MISSING_INPUT), (F.col("_b") <= 0, DIVISION_UNDEFINED)).alias("global_ret_1d"))


def finality(observations: DataFrame, instant: Column, age_days: int = 3) -> DataFrame:
    """State of every (key, day) label as of an instant: REVISED, PLACEHOLDER, CONFIRMED, CONFIRMED_BY_AGE or OPEN.

    ``observations``: key, day, close, observed_at, obs_id.  A label that was seen again unchanged is
    confirmed; one that changed is withheld; one that equals the day before's close is a
    placeholder until confirmed.
    """
    seen = observations.where(F.col("observed_at") < instant)
    first = F.min_by("close", F.struct("observed_at", "obs_id"))
    got = seen.groupBy("key", "day").agg(first.alias("close"), F.count("*").alias("_n"), F.count_distinct("close").alias("_v"), F.min("observed_at").alias("first_at"))
    before = F.lag("close").over(Window.partitionBy("key").orderBy("day"))
    state = (
        F.when(F.col("_v") > 1, "REVISED").when((F.col("_n") == 1) & (F.col("close") == F.col("_p")), "PLACEHOLDER").when(F.col("_n") > 1, "CONFIRMED")
        .when(F.col("first_at") < instant - F.make_dt_interval(F.lit(age_days)), "CONFIRMED_BY_AGE").otherwise("OPEN")
    )
    return got.withColumn("_p", before).select("key", "day", "close", state.alias("state"))


def search(instruments: DataFrame, text: str, limit: int) -> DataFrame:
    """Ranked search: exact symbol, symbol prefix, code, then name; ties by symbol."""
    q = F.lit(text.strip().upper())
    symbol, name = F.upper("symbol"), F.upper("name")
    rank = F.when(symbol == q, 0).when(symbol.startswith(q), 1).when(F.upper("isin") == q, 2).when(name.contains(q), 3)
    return instruments.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "symbol").limit(limit)


def board(bars: DataFrame, n: int) -> DataFrame:
    """Movers: each key's last close against the one before, and its place from the top and from the bottom (the first n of either)."""
    w = Window.partitionBy("key").orderBy(F.desc("bucket"))
    two = bars.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("key").agg(F.max(F.when(F.col("_r") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("_r") == 2, F.col("close"))).alias("_p"))
    moved = two.where("_p > 0").select("key", "close", (F.col("close") / F.col("_p") - 1).alias("move"))
    up = moved.orderBy(F.desc("move"), "key").limit(n).withColumn("side", F.lit("UP"))
    return up.unionByName(moved.orderBy("move", "key").limit(n).withColumn("side", F.lit("DOWN")))


def monitor_state(sources: DataFrame) -> DataFrame:
    """Adds ``state`` of each source by ordered rules.

    ``sources``: polls, failed, limited (counts), minutes_since_ok, norm_gap_minutes, today, usual (item counts), duplicates.
    """
    rules = (
        ("DOWN", (F.col("polls") > 0) & (F.col("failed") == F.col("polls"))),
        ("RATE_LIMITED", F.col("limited") * 2 > F.col("polls")),
        ("STALE", F.col("minutes_since_ok") > 3 * F.col("norm_gap_minutes")),
        ("UNUSUAL_VOLUME", (F.col("usual") >= 5) & ((F.col("today") > 3 * F.col("usual")) | (F.col("today") * 3 < F.col("usual")))),
        ("MOSTLY_DUPLICATES", F.col("duplicates") * 2 > F.col("today")),
    )
    state = F.lit("OK")
    for name, rule in reversed(rules):
        state = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(state)
    return sources.withColumn("state", state)
