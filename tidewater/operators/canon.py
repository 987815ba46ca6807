"""The canonical layer: which instruments count, when a fact is knowable, what a session's data state is, which gates hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MARKET_ZONE, valid_isin
from .gates import violations
from .pit import islands

# Segments, series and bar widths.
EQUITY_SEGMENT, INDEX_SEGMENT = "NSE_EQ", "NSE_INDEX"
GLOBAL_SEGMENTS = ("GLOBAL_INDEX", "GLOBAL_INDICATOR")
TIMEFRAME_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60}
PROVENANCE = ("source", "run_id", "payload_sha256", "fetched_at", "knowable_at")


def universe_decision(segment: Column, series: Column, isin: Column, symbol: Column, key: Column, equity_series: tuple[str, ...], index_keys: tuple[str, ...]) -> Column:
    """(included, reason): whether an instrument belongs to the universe, by the first rule that decides."""
    row = lambda ok, why: F.struct(F.lit(ok).alias("included"), F.lit(why).alias("reason"))
    equity = F.when(~F.upper(F.coalesce(series, F.lit(""))).isin(*equity_series), row(False, "SERIES")).when(~valid_isin(isin) | (F.coalesce(symbol, F.lit("")) == ""), row(False, "MALFORMED")).otherwise(row(True, "EQUITY"))
    index = F.when(key.isin(*index_keys), row(True, "APPROVED_INDEX")).otherwise(row(False, "INDEX_NOT_APPROVED"))
    return F.when(segment == EQUITY_SEGMENT, equity).when(segment == INDEX_SEGMENT, index).when(segment.isin(*GLOBAL_SEGMENTS), row(False, "GLOBAL")).otherwise(row(False, "SEGMENT"))


def preopen_rule(segment: Column, series: Column, equity_series: tuple[str, ...]) -> Column:
    """The one rule that decides on an instrument's pre-open subscription."""
    excluded = F.when(segment != EQUITY_SEGMENT, F.concat(F.lit("excluded:segment="), segment)).when(~F.upper(F.coalesce(series, F.lit(""))).isin(*equity_series), F.concat(F.lit("excluded:series="), F.when(F.coalesce(series, F.lit("")) == "", "<none>").otherwise(series)))
    return F.coalesce(excluded, F.lit("selected"))


def identifier_faults(segment: Column, symbol: Column, isin: Column) -> Column:
    """The names of the identifiers that an instrument lacks."""
    return F.array_compact(F.array(F.when(F.coalesce(symbol, F.lit("")) == "", "symbol"), F.when((segment == EQUITY_SEGMENT) & ~valid_isin(isin), "isin")))


def subscription(keys: DataFrame, per_connection: int, connections: int) -> DataFrame:
    """``key, requests, place, shard``: the distinct keys in order, in runs of ``per_connection``; beyond the capacity the shard is null.

    Every key that is left out has a row of its own.  A catalogue of some thousand keys is numbered.
    """
    named = keys.select(F.trim("key").alias("key")).where("key <> ''")
    one = named.groupBy("key").agg(F.count("*").alias("requests"))
    place = F.row_number().over(Window.orderBy("key"))
    shard = F.floor((F.col("place") - 1) / per_connection).cast("int")
    return one.withColumn("place", place).withColumn("shard", F.when(F.col("place") <= per_connection * connections, shard))


def event_window(timeframe: Column, day: Column, start: Column, open_s: Column, close_s: Column) -> Column:
    """(event_start, event_end) of a bar: the session's hours if daily, else its width, cut at the close (times in seconds of the market's day)."""
    at = lambda s: F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + s), MARKET_ZONE)
    minutes = F.lit(None).cast("int")
    for name, m in TIMEFRAME_MINUTES.items():
        minutes = F.when(timeframe == name, m).otherwise(minutes)
    end = F.timestamp_seconds(F.unix_seconds(start) + minutes * 60)
    known = open_s.isNotNull() & close_s.isNotNull()
    daily = F.struct(F.when(known, at(open_s)).alias("event_start"), F.when(known, at(close_s)).alias("event_end"))
    return F.when(timeframe == "1d", daily).otherwise(F.struct(start.alias("event_start"), F.least(end, at(close_s)).alias("event_end")))


def canonical_bars(bars: DataFrame, instruments: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bars of included instruments on trading days, and those left out with their reason (INSTRUMENT, NO_CALENDAR, NOT_TRADING)."""
    known = bars.join(F.broadcast(calendar.select("day", "is_trading")), "day", "left").join(instruments.select("key", "included"), "key", "left")
    why = F.when(~F.coalesce("included", F.lit(False)), "INSTRUMENT").when(F.col("is_trading").isNull(), "NO_CALENDAR").when(~F.col("is_trading"), "NOT_TRADING")
    marked = known.withColumn("why", why)
    return marked.where("why IS NULL").select(*bars.columns), marked.where("why IS NOT NULL").select(*bars.columns, "why")


def knowable_bar(end: Column, fetched: Column) -> Column:
    """When a bar may be used: not before its end, nor before it was held."""
    return F.greatest(end, fetched)


def knowable_announced(announced: Column, fetched: Column) -> Column:
    """A published fact: its announcement if the vendor names one, else the fetch."""
    return F.coalesce(announced, fetched)


def knowable_on_date(day: Column, fetched: Column) -> Column:
    """A fact of a date without a time: the end of that market day, but not later than it was held."""
    end = F.to_utc_timestamp(F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + 86_399_999), MARKET_ZONE)
    return F.least(end, fetched)


def snapshot_instant(day: Column, kind: Column, preopen_s: Column, open_s: Column) -> Column:
    """The instant of a session's snapshot: a second before the pre-open (or the open, where there is none), or eight minutes into it; null if there is none."""
    at = lambda s: F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + s), MARKET_ZONE)
    before = F.coalesce(preopen_s, open_s) - 1
    return F.when(kind == "PRE_SESSION", at(before)).when(kind == "PRE_OPEN", at(preopen_s + 480))


def request_windows(ranges: DataFrame, months: int) -> DataFrame:
    """Each (start, end) cut at the starts of runs of ``months`` calendar months: one row per window (ranges: id, start, end)."""
    first = F.trunc("start", "year") if months == 12 else F.add_months(F.trunc("start", "year"), (F.floor((F.month("start") - 1) / months) * months).cast("int"))
    cuts = ranges.where("start <= end").withColumn("w", F.explode(F.sequence(first, F.col("end"), F.expr(f"INTERVAL '{months}' MONTH"))))
    return cuts.select("id", F.greatest("w", "start").alias("from_date"), F.least(F.date_sub(F.add_months("w", months), 1), F.col("end")).alias("to_date"))


def session_states(sessions: DataFrame, bars: DataFrame, quarantined: DataFrame, windows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``key, day, bars, quarantined, state`` of every key and session.

    ``sessions``: key, day; ``bars`` and ``quarantined``: key, day; ``windows``: key, from_date, to_date, status,
    started_at; ``checkpoints``: key, from_date, to_date.  DATA before QUARANTINED, EMPTY (a complete
    window held nothing), VENDOR_ERROR (the last attempt failed), MISSING (inside the checkpoint), PENDING_BACKFILL.
    Windows are exploded into their days, so the join is one of equality.
    """
    count = lambda df, name: df.groupBy("key", "day").agg(F.count("*").alias(name))
    days = windows.select("key", "status", "started_at", F.explode(F.sequence("from_date", "to_date")).alias("day"))
    tried = days.groupBy("key", "day").agg(F.bool_or(F.col("status") == "COMPLETE").alias("complete"), F.max_by(F.when(F.col("status") != "COMPLETE", F.col("status")), F.when(F.col("status") != "COMPLETE", F.col("started_at"))).alias("last"))
    s = sessions.join(count(bars, "bars"), ["key", "day"], "left").join(count(quarantined, "quarantined"), ["key", "day"], "left").join(tried, ["key", "day"], "left").join(checkpoints, "key", "left").na.fill(0, ["bars", "quarantined"])
    state = (
        F.when(F.col("bars") > 0, "DATA").when(F.col("quarantined") > 0, "QUARANTINED").when(F.coalesce("complete", F.lit(False)), "EMPTY").when(F.col("last") == "FAILED", "VENDOR_ERROR")
        .when(F.col("day").between(F.col("from_date"), F.col("to_date")), "MISSING").otherwise("PENDING_BACKFILL")
    )
    return s.select("key", "day", "bars", "quarantined", state.alias("state"))


def coverage(states: DataFrame) -> DataFrame:
    """Runs of sessions in one state: key, state, first, last, length."""
    return islands(states, ["key"], "day", "state")


def gates(bars: DataFrame, instruments: DataFrame, calendar: DataFrame, dated: dict[str, DataFrame], actions: DataFrame, news: DataFrame, statements: DataFrame, states: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """The eighteen gates over the canonical layer: ``gate, violations, status``.

    ``bars``: key, timeframe, start, day, open, high, low, close, volume, knowable_at, fetched_at, event_end,
    payload_sha256; ``dated``: further tables with knowable_at and fetched_at.
    """
    kept = bars.join(instruments.where("included").select("key"), "key", "left_semi")
    trading = calendar.where("is_trading").select("day")
    late = bars.select("knowable_at", "fetched_at")
    for df in dated.values():
        late = late.unionByName(df.select("knowable_at", "fetched_at"))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    twice = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    none = lambda *names: F.array_contains(F.array(*[F.col(n).isNull() for n in names]), True)
    axis = calendar.sparkSession.sql(f"SELECT explode(sequence(DATE'{first_day}', DATE'{last_day}')) AS day")
    inc = instruments.where("included")
    return violations(
        {
            "duplicate_bars": twice(kept, "key", "timeframe", "start"),
            "invalid_ohlc": kept.where(~((F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "close"))) | (F.least(*prices) <= 0)),
            "negative_volume": kept.where("volume < 0"),
            "null_required_bar_fields": kept.where(none("open", "high", "low", "close", "volume", "knowable_at", "fetched_at", "payload_sha256")),
            "knowable_after_fetched": late.where("knowable_at > fetched_at"),
            "bar_knowable_before_event_end": kept.where("knowable_at < event_end"),
            "daily_bar_fetched_same_session": kept.where((F.col("timeframe") == "1d") & (F.to_date("fetched_at") <= F.col("day"))),
            "non_session_bars_exposed": kept.join(F.broadcast(trading), "day", "left_anti"),
            "orphan_instruments": bars.join(instruments.select("key"), "key", "left_anti"),
            "invalid_exchange": inc.where(~((F.col("exchange") == "NSE") & F.col("segment").isin(EQUITY_SEGMENT, INDEX_SEGMENT))),
            "invalid_timeframe": kept.where(~F.col("timeframe").isin("1d", *TIMEFRAME_MINUTES)).select("timeframe").distinct(),
            "missing_identifiers": inc.where(F.size(identifier_faults(F.col("segment"), F.col("symbol"), F.col("isin"))) > 0),
            "unexpected_gaps": states.where("state = 'MISSING'"),
            "duplicate_corporate_actions": twice(actions, "isin", "content_sha256"),
            "duplicate_news_mappings": twice(news, "news_id", "key"),
            "invalid_fundamentals": statements.where("payload IS NULL OR payload = 'null' OR statement_type IS NULL"),
            "calendar_gaps_in_depth": axis.join(F.broadcast(calendar.select("day")), "day", "left_anti"),
            "coverage_contradicts_bars": states.where((F.col("state") == "DATA") != (F.col("bars") > 0)),
        }
    )


def coverage_drop(runs: DataFrame, window: int = 5, least: float = 0.8) -> DataFrame:
    """Runs whose rows fall under ``least`` of the mean of the ``window`` runs before (runs: stream, run_no, rows)."""
    w = Window.partitionBy("stream").orderBy("run_no").rowsBetween(-window, -1)
    r = runs.withColumn("baseline", F.avg("rows").over(w))
    return r.withColumn("dropped", (F.col("baseline") > 0) & (F.col("rows") / F.nullif("baseline", F.lit(0.0)) < least))


def incomplete_provenance(rows: DataFrame, required: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """The rows that lack a part of their provenance, with the names of what is missing."""
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), c) for c in required]))
    return rows.withColumn("missing", gone).where(F.size("missing") > 0)


def freshness(runs: DataFrame) -> DataFrame:
    """Per stream the last complete run and the status of the latest one (runs: stream, started_at, run_no, status)."""
    return runs.groupBy("stream").agg(F.max(F.when(F.col("status") == "COMPLETE", F.col("started_at"))).alias("last_complete"), F.max_by("status", F.struct("started_at", "run_no")).alias("latest_status"))


def latency(items: DataFrame, by: list[str]) -> DataFrame:
    """Detection, ingestion and end-to-end lags in seconds: medians, split by market hours, and how many clocks ran ahead.

    ``items``: discovered_at, published_at, processed_at, backlog, in_hours.  Backlog and undated items have no
    detection lag; one of negative lag counts as skewed only.
    """
    s = lambda a, b: (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 1e6
    d = s("discovered_at", "published_at")
    live = ~F.col("backlog") & F.col("published_at").isNotNull()
    good = live & (d >= 0)
    mid = lambda when, x: F.percentile(F.when(when, x), 0.5)
    return items.groupBy(*by).agg(
        F.count_if(good).alias("detected"), mid(good, d).alias("detection_s"), mid(good & F.col("in_hours"), d).alias("detection_hours_s"), mid(good & ~F.col("in_hours"), d).alias("detection_off_s"),
        mid(F.lit(True), s("processed_at", "discovered_at")).alias("ingestion_s"), mid(good, s("processed_at", "published_at")).alias("end_to_end_s"), F.count_if(live & (d < 0)).alias("skewed"),
    )


def availability(reason: Column, families: Column, collected: Column, bar_stale: Column, news_stale: Column) -> Column:
    """What a feature's reason means at an instant: VALID, STALE, NOT_APPLICABLE, INVALID, MISSING_INPUT, or not collected then.

    ``families`` are the input families of the feature, ``collected`` those that were collected by then.
    """
    stale = (F.array_contains(families, "multi_news") & news_stale) | (F.arrays_overlap(families, F.array(F.lit("daily_bar"), F.lit("index_bar"))) & bar_stale)
    empty = reason.isin("MISSING_INPUT", "INSUFFICIENT_HISTORY", "DIVISION_UNDEFINED")
    return (
        F.when(F.size(F.array_except(families, collected)) > 0, "NOT_AVAILABLE_HISTORICALLY").when(reason.isNull(), "VALID").when(reason == "NOT_APPLICABLE", "NOT_APPLICABLE").when(reason == "MALFORMED_INPUT", "INVALID")
        .when(empty, F.when(stale, "STALE").otherwise("MISSING_INPUT")).otherwise("INVALID")
    )


def live_lag(rows: DataFrame, by: list[str], known: Column, base: Column, share: float = 0.99) -> DataFrame:
    """``by, seconds, rows``: the lag that a share of the live rows keep, rounded up to the minute."""
    lag = (F.unix_micros(known.cast("timestamp")) - F.unix_micros(base.cast("timestamp"))) / 1e6
    return rows.groupBy(*by).agg((F.ceil(F.percentile(lag, share) / 60) * 60).cast("long").alias("seconds"), F.count("*").alias("rows"))


def best_links(links: DataFrame) -> DataFrame:
    """``item_id, key, links``: each item's most certain link and how many it has (links: item_id, key, confidence)."""
    w = Window.partitionBy("item_id")
    placed = links.withColumns({"links": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(F.desc("confidence"), "key"))})
    return placed.where("_r = 1").select("item_id", "key", "links")


def news_in_trades(trades: DataFrame, links: DataFrame, slot_hours: int = 24) -> DataFrame:
    """``trade_id, item_id``: the items of a trade's key that became knowable strictly inside it (trades: trade_id, key, entry_at, exit_at).

    A trade is laid out over the slots that it spans, so the join is one of equality on key and slot.
    """
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (3600 * slot_hours))
    spread = trades.withColumn("_slot", F.explode(F.sequence(slot("entry_at"), slot("exit_at"))))
    return spread.join(links.withColumn("_slot", slot("knowable_at")), ["key", "_slot"]).where((F.col("knowable_at") > F.col("entry_at")) & (F.col("knowable_at") < F.col("exit_at"))).select("trade_id", "item_id").distinct()


def inside_trades(signals: DataFrame, trades: DataFrame, slot_hours: int = 24) -> DataFrame:
    """``signal_id, open_trades``: how many trades of a signal's key are open at it, entry included (signals: signal_id, key, at)."""
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (3600 * slot_hours))
    spread = trades.withColumn("_slot", F.explode(F.sequence(slot("entry_at"), slot("exit_at"))))
    met = signals.withColumn("_slot", slot("at")).join(spread, ["key", "_slot"]).where((F.col("entry_at") <= F.col("at")) & (F.col("at") < F.col("exit_at")))
    return signals.select("signal_id").join(met.groupBy("signal_id").agg(F.count_distinct("trade_id").alias("open_trades")), "signal_id", "left").na.fill(0, ["open_trades"])


def screen(latest: DataFrame, sector: str | None = None, price: tuple[float | None, float | None] = (None, None), pe: tuple[float | None, float | None] = (None, None), limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a stock list by volume: sector and price are filtered before the page is cut, the P/E range after it (latest: key, sector, close, volume, pe)."""
    from .pit import between

    rows = latest if sector is None else latest.where(F.col("sector") == sector)
    page = between(rows, "close", *price).orderBy(F.desc("volume"), "key").offset(offset).limit(limit)
    return between(page, "pe", *pe)


def where_any(df: DataFrame, allowed: tuple[str, ...], **wanted) -> DataFrame:
    """The rows that meet all named conditions: a value, a list of values, or a member of an array column; unknown names are refused."""
    unknown = set(wanted) - set(allowed)
    if unknown:
        raise ValueError(f"not a filter: {sorted(unknown)}")
    kinds = dict(df.dtypes)
    for name, value in wanted.items():
        if value is not None:
            c = F.col(name)
            df = df.where(F.array_contains(c, value) if kinds[name].startswith("array") else c.isin(*value) if isinstance(value, (list, tuple)) else c == value)
    return df


def by_axis(trades: DataFrame, axes: list[str]) -> DataFrame:
    """``strategy, axis, state, trades, hit_rate, net, mean_r``: each trade counted once under every regime axis (trades: strategy, net, r, axes)."""
    long = trades.select("strategy", "net", "r", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("state")) for a in axes])).alias("x")).select("strategy", "net", "r", "x.*")
    return long.groupBy("strategy", "axis", "state").agg(F.count("*").alias("trades"), F.avg((F.col("net") > 0).cast("int")).alias("hit_rate"), F.sum("net").alias("net"), F.avg("r").alias("mean_r"))
