"""Replay: what each instant of a list would have seen, all instants in one plan.

A fact is visible from just after it became knowable until its next version did, so its
versions are intervals of time.  Instants meet the intervals by equality on slots of time:
an interval is laid out over the slots that it spans, and what a slot brings together is
compared exactly.  The facts are read once, however many instants there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reasons import DIVISION_UNDEFINED, INSUFFICIENT_HISTORY, MISSING_INPUT, finish, result, unfinished
from .alike import stored
from .bars import DEPTHS, along, features, with_volatility
from .pit import insert_if_absent
from .snapshot import FOLDED, HISTORY_DAYS, INPUTS, OTHERS, STOCK_FEATURES, last_visible, ranked_rows, visible_rows

#: Days of bars in which a key has to have one to belong to an instant's universe.
UNIVERSE_DAYS = 30
#: Returns that a beta is of.
BETA = 60
OBSERVED, ASSUMED = "OBSERVED", "ASSUMED"


def validity(facts: DataFrame, keys: list[str], order: list[str], knowable: str = "knowable_at") -> DataFrame:
    """The facts with ``superseded_at``: when the next version of the same keys became knowable (null: it is the last).

    Versions are ordered by ``knowable`` and then ``order`` (name a unique column last); of
    two that became knowable together the earlier one is never visible.
    """
    return facts.withColumn("superseded_at", F.lead(knowable).over(Window.partitionBy(*keys).orderBy(knowable, *order)))


def _expires(bucket: Column, days: int) -> Column:
    """Until when a bar is in the history window."""
    return bucket + F.expr(f"INTERVAL '{days}' DAY")


def _slot(at: Column, seconds: int) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at) / seconds)


def seen(facts: DataFrame, instants: DataFrame, until: Column | None = None, slot_seconds: int = 86_400, knowable: str = "knowable_at") -> DataFrame:
    """Each fact once for every instant that sees it: ``knowable < as_of``, and ``as_of <= until`` unless that is null.

    ``instants`` has ``as_of`` (distinct) and whatever goes with it; ``facts`` has no such
    columns.  ``slot_seconds`` trades rows before the join (an interval's slots) against rows
    after it (instants a slot); the result does not depend on it.  The instants, a calendar, are
    what is broadcast: facts are never sent to the driver and no slot has to meet in one task.
    """
    first, last = instants.agg(F.min("as_of"), F.max("as_of")).first()
    if first is None:
        return facts.join(instants, F.lit(False))
    first, last = (F.lit(x).cast(instants.schema["as_of"].dataType) for x in (first, last))
    start = F.greatest(F.col(knowable), first)
    end = F.least(last, until) if until is not None else last  # least leaves nulls out
    laid = facts.withColumns({"_from": F.col(knowable), "_until": end}).where((F.col("_from") < last) & (start <= F.col("_until")))
    laid = laid.withColumn("_slot", F.explode(F.sequence(_slot(start, slot_seconds), _slot(F.col("_until"), slot_seconds))))
    both = laid.join(F.broadcast(instants.withColumn("_slot", _slot(F.col("as_of"), slot_seconds))), "_slot")  # a calendar; by its file's size the other side may look smaller
    return both.where((F.col("_from") < F.col("as_of")) & (F.col("as_of") <= F.col("_until"))).drop("_slot", "_from", "_until")


def versions(facts: DataFrame, instants: DataFrame, keys: list[str], order: list[str], slot_seconds: int = 86_400) -> DataFrame:
    """The version of each fact that every instant sees: one row per instant and keys that had one."""
    return seen(validity(facts, keys, order), instants, F.col("superseded_at"), slot_seconds).drop("superseded_at")


def visible_bars(bars: DataFrame, instants: DataFrame, history_days: int = HISTORY_DAYS, slot_seconds: int = 86_400) -> DataFrame:
    """The bars of each instant's history window; of a bar's versions the latest that the instant sees.

    ``bars``: key, bucket, knowable_at and values, and maybe ``version`` (a revised bar has several).
    """
    order = ["version"] if "version" in bars.columns else []
    return seen(validity(bars, ["key", "bucket"], order), instants, F.least("superseded_at", _expires(F.col("bucket"), history_days)), slot_seconds).drop("superseded_at")


def universe(bars: DataFrame, instants: DataFrame, days: int = UNIVERSE_DAYS, slot_seconds: int = 86_400) -> DataFrame:
    """``as_of, key, last_bucket, stale`` of each instant's keys: those with a visible bar in the last ``days``; stale if it is not of the previous session.

    ``instants``: as_of, previous_session.
    """
    last = visible_bars(bars.select("key", "bucket", "knowable_at"), instants, days, slot_seconds).groupBy("as_of", "previous_session", "key").agg(F.max("bucket").alias("last_bucket"))
    return last.select("as_of", "key", "last_bucket", (F.col("last_bucket") != F.col("previous_session")).alias("stale"))


def replay_bars(
    bars: DataFrame, index: DataFrame, instants: DataFrame, sectors: DataFrame | None = None, history_days: int = HISTORY_DAYS, names: tuple[str, ...] = STOCK_FEATURES, slot_seconds: int = 86_400, others: tuple[str, ...] = OTHERS, provenance: bool = True
) -> DataFrame:
    """The instrument rows of the snapshots of all instants: those of one snapshot an instant, with its ``as_of``.

    ``instants``: as_of, previous_session; ``sectors``: key, sector; ``others``: which features to make
    beside those of ``names``; ``provenance``: whether rows have the inputs' greatest knowable_at and hash.

    With folds or provenance, which are of all bars that an instant sees, a key and an instant
    together are the key of every window, fold and median, so what one snapshot does for keys
    this plan does for pairs.  Bars are shuffled by their key before they are laid out over the
    instants, and all windows are within a key: a bar is written once, however many instants see
    it.  The tasks are as many as ``spark.sql.shuffle.partitions`` says, because what they read is less than what they make of it.

    Without them a bar's features are made once for all instants, see :func:`_last_bars`.
    """
    with_sector = None
    if sectors is not None:
        with_sector = lambda df: df.join(sectors.select("key", "sector"), "key", "left")
    if not provenance and not any(n in FOLDED for n in others):
        last = _last_bars(bars, index, instants, history_days, names, slot_seconds, others)
        rows = ranked_rows(last, F.col("previous_session"), with_sector, ("key", "as_of"), (*names, *others), ())
        return rows.select("as_of", "scope", "key", "feature_id", "value", "reason")
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = visible_bars(bars.repartition(tasks, "key"), instants, history_days, slot_seconds)
    rows = visible_rows(found, visible_bars(index, instants, history_days, slot_seconds), F.col("previous_session"), with_sector, ("key", "as_of"), names, others)
    if not provenance:
        rows = rows.drop(*INPUTS)
    return rows.select("as_of", "scope", "key", *[c for c in rows.columns if c not in ("as_of", "scope", "key")])


def _last_bars(bars: DataFrame, index: DataFrame, instants: DataFrame, history_days: int, names: tuple[str, ...], slot_seconds: int, others: tuple[str, ...]) -> DataFrame:
    """Each instant's last visible bar of every key with its features, made from the rows of bars instead of those of pairs.

    What an instant sees of a key is as a rule all bars up to some bar, in their last versions.
    Then a feature of the last n bars is that bar's own, whatever the instant, if the first of
    the n has not left the history window; only the bars' last ones are laid out.  Pairs of a key
    and an instant for which that does not hold (:func:`_odd_pairs`) are laid out bar by bar.
    The calendar, the index and the odd pairs are stored.
    """
    beta = "beta_60" in others
    instants = stored(instants, "instants")
    if beta:
        index = stored(index.select(*[c for c in ("key", "bucket", "close", "knowable_at", "version") if c in index.columns]), "index-bars")
        instants = stored(_index_seen(index, instants, history_days, slot_seconds), "instants-index")
    # what a task reads is less than what it makes: no coalescing by size
    marked = _prefixes(bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key"))
    odd = stored(_odd_pairs(marked, instants, history_days, slot_seconds, beta), "odd-pairs")
    made = (*names, *[n for n in others if n != "beta_60"])
    starts = sorted({DEPTHS[n] for n in made})
    rows = marked.where(~F.col("_odd"))
    if beta:  # before the features: its rows are sorted twice more
        rows = _with_returns(rows, _last_versions(index), history_days)
    rows = rows.withColumns({f"_start{n}": F.lag("bucket", n - 1).over(along()) for n in starts})
    with unfinished():
        rows = features(rows, list(names))
        if "volatility_20" in others:
            rows = with_volatility(rows)
    kept = ["key", "bucket", "_known", "_next", *made, *[f"_start{n}" for n in starts], *(["_beta", "_beta_before"] if beta else [])]
    pairs = seen(rows.select(*kept), instants, F.least("_next", _expires(F.col("bucket"), history_days)), slot_seconds, "_known")
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit(INSUFFICIENT_HISTORY).alias("reason"))
    whole = {n: F.when(F.col("as_of") <= _expires(F.col(f"_start{DEPTHS[n]}"), history_days), finish(F.col(n))).otherwise(none) for n in made}
    if beta:
        whole["beta_60"] = _beta_of(history_days)
    columns = ["key", "as_of", "previous_session", "bucket"]
    last = pairs.select(*columns, *[c.alias(n) for n, c in whole.items()])
    if odd.isEmpty():
        return last
    at = odd.select(F.col("key").alias("_k"), F.col("as_of").alias("_t"))
    these = F.col("key").eqNullSafe(F.col("_k"))
    found = visible_bars(bars.join(at.select("_k").distinct(), these, "left_semi"), instants, history_days, slot_seconds)
    found = found.join(at, these & (F.col("as_of") == F.col("_t")), "left_semi")
    rest = last_visible(found, visible_bars(index, instants.select("as_of"), history_days, slot_seconds), ("key", "as_of"), names, others)
    return last.join(at, these & (F.col("as_of") == F.col("_t")), "left_anti").unionByName(rest.select(*columns, *whole))


def _prefixes(bars: DataFrame) -> DataFrame:
    """The bars, all versions, with ``_known``: since when they and all before them are; ``_next``: until when they are the last of which that holds.

    ``_odd`` marks rows that are replaced, at ``superseded_at``, by a later version of the bar (or have no bucket),
    ``_hole`` is when the last of the bars before became knowable.
    """
    order = ["bucket", "knowable_at", *(["version"] if "version" in bars.columns else [])]
    w = Window.partitionBy("key").orderBy(*order)
    after = F.lead("knowable_at").over(w)
    upto = lambda last: F.max("knowable_at").over(w.rowsBetween(Window.unboundedPreceding, last))
    marked = bars.where(F.col("knowable_at").isNotNull()).withColumns({"_after": after, "_again": F.lead("bucket").over(w).eqNullSafe(F.col("bucket")), "_known": upto(0), "_hole": upto(-1)})
    replaced = F.col("_after").isNotNull() & F.col("_again")
    return marked.withColumns({
        "superseded_at": F.when(replaced, F.col("_after")), "_odd": replaced | F.col("bucket").isNull(), "_next": F.when(F.col("_after").isNotNull(), F.greatest("_known", "_after")),
    }).drop("_after", "_again")


def _odd_pairs(marked: DataFrame, instants: DataFrame, history_days: int, slot_seconds: int, beta: bool) -> DataFrame:
    """``key, as_of`` of the pairs that see an earlier version of a bar, or a bar without one before it.

    For a beta also those whose index is odd in that way, or ends before the bar before the key's last one.
    """
    span = lambda start, end, check: F.struct(start.alias("start"), end.alias("end"), F.lit(check).alias("check"))
    at = F.col("knowable_at")
    spans = [F.when(F.col("_odd"), span(at, F.col("superseded_at"), False)), F.when(~F.col("_odd") & (at < F.col("_hole")), span(at, F.col("_hole"), False))]
    if beta:
        spans.append(F.when(~F.col("_odd"), span(F.col("_known"), F.col("_next"), True)))
        marked = marked.withColumn("_before", F.lag("bucket").over(along()))
    rows = marked.select("key", "bucket", *(["_before"] if beta else []), F.explode(F.array_compact(F.array(*spans))).alias("_span")).select("*", "_span.*").drop("_span")
    pairs = seen(rows, instants, F.least("end", _expires(F.col("bucket"), history_days)), slot_seconds, "start")
    if beta:
        pairs = pairs.where(~F.col("check") | F.col("_index_odd") | (F.col("_index_to") < F.col("_before")))
    return pairs.select("key", "as_of").distinct()


def _last_versions(bars: DataFrame) -> DataFrame:
    order = ["version"] if "version" in bars.columns else []
    known = bars.where(F.col("knowable_at").isNotNull() & F.col("bucket").isNotNull())
    return validity(known, ["key", "bucket"], order).where(F.col("superseded_at").isNull()).drop("superseded_at")


def _index_seen(index: DataFrame, instants: DataFrame, history_days: int, slot_seconds: int) -> DataFrame:
    """The instants with ``_index_from, _index_to``, the first and last bucket that they see of the index, and ``_index_odd``: whether they lack one between or see an earlier version."""
    order = ["version"] if "version" in index.columns else []
    known = validity(index.where(F.col("knowable_at").isNotNull() & F.col("bucket").isNotNull()), ["key", "bucket"], order)
    placed = known.withColumn("_i", F.dense_rank().over(along())).select("bucket", "knowable_at", "superseded_at", "_i")
    met = seen(placed, instants.select("as_of"), F.least("superseded_at", _expires(F.col("bucket"), history_days)), slot_seconds).groupBy("as_of")
    odd = (F.max("_i") - F.min("_i") + 1 != F.count("*")) | F.bool_or(F.col("superseded_at").isNotNull())
    both = instants.join(met.agg(F.min("bucket").alias("_index_from"), F.max("bucket").alias("_index_to"), odd.alias("_index_odd")), "as_of", "left")
    return both.withColumn("_index_odd", F.coalesce("_index_odd", F.lit(False)))


def _with_returns(bars: DataFrame, index: DataFrame, history_days: int) -> DataFrame:
    """The bars with ``_beta``, of the last returns up to each that the index has too, and ``_beta_before``, that of the bar before.

    Both are structs: slope and var of the last :data:`BETA` such returns, the bucket of the newest and the oldest
    of them, and of the bars before those two.  ``index`` has one bar a bucket; its returns are broadcast.

    A frame of that many rows is dear, so returns that are in no frame which an instant may see
    whole are left to groups of their own.
    """
    before = F.lag("close").over(along())
    steps = index.withColumn("_p", before).where("_p > 0").select("bucket", (F.col("close") / F.col("_p") - 1).alias("_x"), F.lit(True).alias("_in"))
    both = bars.withColumns({"_p": before, "_before": F.lag("bucket").over(along())}).join(F.broadcast(steps), "bucket", "left")
    both = both.withColumn("_on", F.coalesce(F.col("_in") & (F.col("_p") > 0), F.lit(False)))
    back = lambda c: F.lag(c, BETA - 1).over(met)
    met = Window.partitionBy("key", "_on").orderBy("bucket")
    upto = met.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"_oldest": back("bucket"), "_oldest_before": back("_before")})
    both = both.withColumn("_full", F.coalesce(F.col("_on") & (F.col("_known") < _expires(F.col("_oldest_before"), history_days)), F.lit(False)))
    both = both.withColumns({"_fulls": F.count_if("_full").over(upto), "_all": F.count_if("_full").over(met.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    both = both.withColumn("_used", F.col("_full") | (F.coalesce(F.lead("_fulls", BETA - 1).over(met), "_all") > F.col("_fulls")))
    both = both.withColumn("_run", F.count_if(~F.col("_used")).over(upto))  # a row that is not used, and the used ones up to the next
    frame = Window.partitionBy("key", "_on", "_run").orderBy("bucket").rowsBetween(1 - BETA, Window.currentRow)
    r, x = F.when(F.col("_used"), F.col("close") / F.col("_p") - 1), F.when(F.col("_used"), F.col("_x"))
    both = both.withColumns({"_slope": F.when(F.col("_full"), F.regr_slope(r, x).over(frame)), "_var": F.when(F.col("_full"), F.var_pop(x).over(frame))})
    own = F.struct(F.col("_slope").alias("slope"), F.col("_var").alias("var"), F.col("bucket").alias("newest"), F.col("_before").alias("newest_before"), F.col("_oldest").alias("oldest"), F.col("_oldest_before").alias("oldest_before"))
    last = lambda end: F.last(F.when(F.col("_on"), own), ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, end))
    both = both.withColumns({"_beta": last(0), "_beta_before": last(-1)})
    return both.select(*bars.columns, "_beta", "_beta_before")


def _beta_of(history_days: int) -> Column:
    """The beta of a pair: of the returns up to its last bar, or up to the one before if the index that it sees ends there."""
    to_last = F.col("_index_to") >= F.col("bucket")
    of = lambda c: F.when(to_last, F.col(f"_beta.{c}")).when(F.col("_index_to").isNotNull(), F.col(f"_beta_before.{c}"))
    # a return takes part if the instant sees the bar before it too, of both series
    sees = lambda end: F.coalesce((F.col("as_of") <= _expires(of(f"{end}_before"), history_days)) & (of(end) > F.col("_index_from")), F.lit(False))
    return result(of("slope"), (~sees("newest"), MISSING_INPUT), (~sees("oldest"), INSUFFICIENT_HISTORY), (of("var") == 0, DIVISION_UNDEFINED))


def undone(instants: DataFrame, stored: DataFrame) -> DataFrame:
    """The instants that no stored row belongs to: a run that was broken off goes on with them."""
    return instants.join(stored.select("as_of").distinct(), "as_of", "left_anti")


def to_append(stored: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a replay that are not stored yet, and those whose stored values or inputs differ (nothing is overwritten)."""
    return insert_if_absent(stored, rows, ["as_of", "scope", "key", "feature_id"], ["value", "reason", "inputs_sha256"])


# -- as if live: when a fact that was loaded later would have become knowable ---------------


def _earlier(df: DataFrame, assumed: Column, knowable: str) -> DataFrame:
    """``knowable`` moved to ``assumed`` where that is earlier (and known), with ``knowable_basis``."""
    moved = assumed.isNotNull() & (assumed < F.col(knowable))
    return df.withColumns({"knowable_basis": F.when(moved, ASSUMED).otherwise(OBSERVED), knowable: F.when(moved, assumed).otherwise(F.col(knowable))})


def next_session_live(facts: DataFrame, axis: DataFrame, seconds: int, day: str = "day", knowable: str = "knowable_at") -> DataFrame:
    """As if each fact of a day had been fetched ``seconds`` after the start of the next session (never later than it was).

    ``axis``: day, next_session, a calendar as from :func:`pit.sessions`.  A fact of a day that
    is no session goes with the first session after it; one behind the calendar's end stays
    as it is.
    """
    days = facts.select(F.col(day).alias("_d"), F.lit(None).cast(axis.schema["day"].dataType).alias("_open")).distinct()
    both = days.union(axis.select("day", "day")).groupBy("_d").agg(F.max("_open").alias("_open"))
    w = Window.orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)  # a calendar: some hundred rows a year, whatever the data
    after = both.select("_d", F.last("_open", ignorenulls=True).over(w).alias("_next"))
    moved = _earlier(facts.join(after, F.col(day) == F.col("_d"), "left"), F.col("_next").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(seconds)), knowable)
    return moved.select(*facts.columns, "knowable_basis")


def event_live(facts: DataFrame, seconds: int, event: str = "ex_at", fetched: str = "fetched_at", knowable: str = "knowable_at") -> DataFrame:
    """As if each fact had been fetched ``seconds`` after its event: not before it was announced, and not later than it was fetched."""
    strict = F.greatest(knowable, fetched)
    assumed = F.greatest(F.col(knowable), F.col(event) + F.make_dt_interval(secs=F.lit(seconds)))
    return _earlier(facts.withColumns({"_a": F.when(F.col(event).isNotNull(), assumed), knowable: strict}), F.col("_a"), knowable).drop("_a")


def weekday_live(facts: DataFrame, lags: DataFrame, day: str = "day", knowable: str = "knowable_at") -> DataFrame:
    """As if each fact had been fetched its weekday's lag after midnight (lags: weekday from 0 for Monday, first_seconds, confirm_seconds).

    ``confirmed_at`` is when an unchanged second look would have followed; null where nothing was assumed.
    """
    at = F.col(day).cast("timestamp_ntz")
    moved = facts.join(F.broadcast(lags), F.weekday(day) == F.col("weekday"), "left")  # seven rows
    moved = moved.withColumns({"_first": at + F.make_dt_interval(secs=F.col("first_seconds")), "_second": at + F.make_dt_interval(secs=F.col("confirm_seconds"))})
    moved = _earlier(moved, F.col("_first"), knowable)
    return moved.select(*facts.columns, "knowable_basis", F.when(F.col("knowable_basis") == ASSUMED, F.col("_second")).alias("confirmed_at"))


def measured_weekday_lags(facts: DataFrame, day: str = "day", first: str = "first_at", confirmed: str = "confirmed_at", least_confirm: int = 6 * 3600) -> DataFrame:
    """``weekday, first_seconds, confirm_seconds, rows`` of all seven weekdays, from facts that were collected live.

    Each is the longest lag after midnight, up to the full minute; a weekday without facts has
    the worst of the others'; a confirmation is at least ``least_confirm`` behind the first look.
    """
    since = lambda c: F.timestamp_diff("MICROSECOND", F.col(day).cast("timestamp_ntz"), F.col(c)) / 1e6
    met = facts.groupBy(F.weekday(day).alias("weekday")).agg(F.max(since(first)).alias("_f"), F.max(since(confirmed)).alias("_c"), F.count("*").alias("rows"))
    worst = met.agg(F.max("_f").alias("_wf"), F.max("_c").alias("_wc"))
    week = facts.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    minute = lambda c: (F.ceil(c / 60) * 60).cast("long")
    both = week.join(F.broadcast(met), "weekday", "left").join(F.broadcast(worst), F.lit(True))  # seven rows and one
    f = F.coalesce("_f", "_wf")
    return both.select("weekday", minute(f).alias("first_seconds"), minute(F.greatest(F.coalesce("_c", "_wc"), f + least_confirm)).alias("confirm_seconds"), F.coalesce("rows", F.lit(0)).alias("rows"))
