"""Costs, price paths, patterns, regimes, and books.

A book's tranches are joins and running products; where a trade's admission depends on
those before it, a session's candidates are folded in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rates:
    """Charges of an order; shares of its value unless named otherwise."""

    brokerage_flat: float = 20.0
    brokerage_share: float | None = 0.001
    stt_buy: float = 0.001
    stt_sell: float = 0.001
    stamp_buy: float = 0.00015
    exchange: float = 0.0000297
    sebi: float = 0.000001
    gst: float = 0.18
    depository_sell: float = 13.5


def order_costs(value: Column, is_buy: Column, r: Rates = Rates()) -> Column:
    """A struct (brokerage, statutory, depository) in money; nothing for an order without value."""
    flat = F.lit(r.brokerage_flat)
    fee = flat if r.brokerage_share is None else F.least(flat, value * r.brokerage_share)
    venue = value * (r.exchange + r.sebi)
    tax = value * F.when(is_buy, r.stt_buy).otherwise(r.stt_sell)
    stamp = F.when(is_buy, value * r.stamp_buy).otherwise(0.0)
    part = lambda x: F.when(value > 0, x).otherwise(0.0)
    return F.struct(
        part(fee * (1 + r.gst)).alias("brokerage"),
        part(venue * (1 + r.gst) + tax + stamp).alias("statutory"),
        part(F.when(is_buy, 0.0).otherwise(r.depository_sell * (1 + r.gst))).alias("depository"),
    )


def day_costs(trades: DataFrame, by: list[str], capital: float, half_spread_bps: float = 5.0, slippage_bps: float = 0.0, multiplier: float = 1.0, rates: Rates = Rates(), measured: str | None = None) -> DataFrame:
    """Per group, each part of its trades' costs as a share of the capital: brokerage, statutory, depository, spread, slippage, cost.

    ``trades``: weight (share of the book traded) and is_buy; ``measured`` names a column of
    half spreads in basis points that goes before the fallback where it has a value.
    """
    value = F.col("weight") * capital
    half = F.coalesce(F.col(measured), F.lit(half_spread_bps)) if measured else F.lit(half_spread_bps)
    each = trades.select(*by, order_costs(value, F.col("is_buy"), rates).alias("_c"), (value * half / 10_000).alias("_s"), (value * slippage_bps / 10_000).alias("_i"))
    share = lambda c: F.sum(c) * multiplier / capital
    got = each.groupBy(*by).agg(share("_c.brokerage").alias("brokerage"), share("_c.statutory").alias("statutory"), share("_c.depository").alias("depository"), share("_s").alias("spread"), share("_i").alias("slippage"))
    return got.withColumn("cost", F.col("brokerage") + F.col("statutory") + F.col("depository") + F.col("spread") + F.col("slippage"))


def session_costs(returns: DataFrame, by: str, capital: float, half_spread_bps: float = 5.0, slippage_bps: float = 0.0, multiplier: float = 1.0, rates: Rates = Rates()) -> DataFrame:
    """``by, cost``: a round trip within each session on equal shares, bought at the open and sold at what they have become (returns: by, key, r)."""
    share = 1 / F.count("*").over(Window.partitionBy(by))
    legs = returns.withColumn("_w", share).select(by, F.explode(F.array(F.struct(F.col("_w").alias("weight"), F.lit(True).alias("is_buy")), F.struct((F.col("_w") * (1 + F.col("r"))).alias("weight"), F.lit(False).alias("is_buy")))).alias("_l"))
    return day_costs(legs.select(by, "_l.*"), [by], capital, half_spread_bps, slippage_bps, multiplier, rates).select(by, "cost")


def _beside(trades: DataFrame, bars: DataFrame, until: str, slot_hours: int) -> DataFrame:
    """Trades with the bars of their key from the entry's slot to that of ``until``: joined by equality on key and slot.

    A trade is laid out over the slots that it spans, so a hot key meets its own hours only.
    """
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (3600 * slot_hours))
    spread = trades.where(F.col("entry_at") <= F.col(until)).withColumn("_slot", F.explode(F.sequence(slot("entry_at"), slot(until))))
    return spread.join(bars.withColumn("_slot", slot("bucket")), ["key", "_slot"]).drop("_slot")


def paths(trades: DataFrame, bars: DataFrame, width: str, slot_hours: int = 24) -> DataFrame:
    """How each trade ends: ``trade_id, exit_at, exit_price, exit_reason``.

    ``trades``: trade_id, key, side (+1 or -1), entry_at, stop, target, time_stop.  ``bars``: key,
    bucket, open, high, low, close, ``width`` (an interval) long.  Within a bar the stop
    comes first, and from the second bar on an open beyond it fills at the open
    (STOP_GAP); then the target; at the time stop the close (TIME); a series that ends
    before it closes at its last bar (NO_EXIT_BAR).  Without a bar at the entry there is no path.

    Trades meet only bars of the slots between entry and time stop, and the first event is
    an aggregate: no series is collected.
    """
    end = F.col("bucket") + F.expr(width)
    near = _beside(trades, bars, "time_stop", slot_hours).where((F.col("bucket") >= F.col("entry_at")) & (end <= F.col("time_stop")))
    long = F.col("side") > 0
    through = lambda price, level: F.when(long, price <= level).otherwise(price >= level)
    reached = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    worst = F.when(long, F.col("low")).otherwise(F.col("high"))
    gap = (F.col("bucket") > F.col("entry_at")) & through(F.col("open"), F.col("stop"))
    event = (
        F.when(gap, F.struct(F.lit("STOP_GAP").alias("reason"), F.col("open").alias("price")))
        .when(through(worst, F.col("stop")), F.struct(F.lit("STOP").alias("reason"), F.col("stop").alias("price")))
        .when(reached, F.struct(F.lit("TARGET").alias("reason"), F.col("target").alias("price")))
        .when(end == F.col("time_stop"), F.struct(F.lit("TIME").alias("reason"), F.col("close").alias("price")))
    )
    near = near.withColumns({"_event": event, "_end": end})
    got = near.groupBy("trade_id").agg(
        F.min_by(F.when(F.col("_event").isNotNull(), F.struct("_end", "_event")), F.when(F.col("_event").isNotNull(), F.col("bucket"))).alias("_first"),
        F.max_by(F.struct("_end", F.struct(F.lit("NO_EXIT_BAR").alias("reason"), F.col("close").alias("price")).alias("_event")), F.col("bucket")).alias("_last"),
        F.bool_or(F.col("bucket") == F.col("entry_at")).alias("_entered"),
    )
    out = F.coalesce("_first", "_last")
    return got.where("_entered").select("trade_id", out["_end"].alias("exit_at"), out["_event"]["price"].alias("exit_price"), out["_event"]["reason"].alias("exit_reason"))


def excursions(trades: DataFrame, bars: DataFrame, slot_hours: int = 24) -> DataFrame:
    """``trade_id, mfe, mae``: the best and worst move from the entry price inside each trade, in shares of it."""
    inside = _beside(trades, bars, "exit_at", slot_hours).where((F.col("bucket") >= F.col("entry_at")) & (F.col("bucket") < F.col("exit_at")))
    up, down = F.max("high") / F.first("entry_price") - 1, F.min("low") / F.first("entry_price") - 1
    side = F.first("side")
    return inside.groupBy("trade_id").agg(F.when(side > 0, up).otherwise(-down).alias("mfe"), F.when(side > 0, down).otherwise(-up).alias("mae"))


def drawdown_flags(df: DataFrame, by: list[str], order: str, net: str, equity: float, half: float = 0.05, halt: float = 0.1) -> DataFrame:
    """Whether the losses up to the session before halve or halt risk (DD_HALF, DD_HALT)."""
    w = Window.partitionBy(*by).orderBy(order)
    cum = F.coalesce(F.sum(net).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = df.withColumn("_cum", cum)
    depth = (F.greatest(F.max("_cum").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0)) - F.col("_cum")) / equity
    return d.withColumn("flags", F.array_compact(F.array(F.when(depth >= half, "DD_HALF"), F.when(depth >= halt, "DD_HALT")))).drop("_cum")


def position_size(risk_per_share: Column, factor: Column, entry: Column, median_volume: Column, risk: float, notional: float, participation: float) -> Column:
    """Whole shares: the risk budget over the risk of one, capped by notional and by a share of usual volume."""
    budget = F.floor(F.floor(F.lit(risk) / risk_per_share) * factor)
    room = F.least(budget, F.floor(F.lit(notional) / entry), F.coalesce(F.floor(median_volume * participation), F.lit(0)))
    return F.when(risk_per_share > 0, F.greatest(room, F.lit(0))).otherwise(0).cast("long")


def patterns(bars: DataFrame, body_min: float = 0.6, close_pos: float = 0.75, wick_min: float = 2.0) -> DataFrame:
    """The names of the candle patterns that each bar shows, in a fixed order (``patterns``)."""
    w = Window.partitionBy("key").orderBy("bucket")
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, pc, ph, pl = (F.lag(x).over(w) for x in ("open", "close", "high", "low"))
    body, span = F.abs(c - o), h - lo
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    solid = (span > 0) & (body > 0)
    big = solid & (body >= span * body_min)
    rules = {
        "STRONG_UP": big & (c > o) & ((c - lo) / span >= close_pos),
        "STRONG_DOWN": big & (c < o) & ((h - c) / span >= close_pos),
        "HAMMER": solid & (lower >= body * wick_min) & (upper <= body),
        "SHOOTING_STAR": solid & (upper >= body * wick_min) & (lower <= body),
        "BULL_ENGULFING": solid & (pc < po) & (c > o) & (o <= pc) & (c >= po),
        "BEAR_ENGULFING": solid & (pc > po) & (c < o) & (o >= pc) & (c <= po),
        "DOJI": (span > 0) & (body <= span * 0.1),
        "INSIDE_BAR": (h < ph) & (lo > pl),
        "GAP_UP": lo > ph,
        "GAP_DOWN": h < pl,
    }
    return bars.withColumn("patterns", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])))


# The regime rules' thresholds and the risk multiplier of each state.
REGIME = {"vix_pct_shock": 0.90, "vix_jump": 0.20, "sigma_shock": 2.0, "ad_collapse": 0.2, "results_share_event": 0.05, "adx_trend": 25, "breadth_up": 0.60, "breadth_down": 0.40, "adx_range": 20}
MULTIPLIER = {"SHOCK": 0.0, "EVENT_WAIT": 0.5, "TREND_UP": 1.0, "TREND_DOWN": 1.0, "RANGE": 0.75, "MIXED": 0.0}


def regime(f: DataFrame) -> DataFrame:
    """Adds ``state`` and ``multiplier``: the first rule that holds; a missing input satisfies none."""
    r = REGIME
    holds = lambda c: F.coalesce(c, F.lit(False))
    shock = holds(F.col("vix_pct252") >= r["vix_pct_shock"]) | holds(F.col("vix_chg_1d") >= r["vix_jump"]) | holds(F.abs("index_ret_1d") >= F.col("index_sigma20") * r["sigma_shock"]) | holds(F.col("ad_ratio") <= r["ad_collapse"])
    strong = holds(F.col("index_adx14") >= r["adx_trend"])
    state = (
        F.when(shock, "SHOCK")
        .when(holds(F.col("calendar_events") > 0) | holds(F.col("results_share") >= r["results_share_event"]), "EVENT_WAIT")
        .when(strong & holds(F.col("above_ema50")) & holds(F.col("breadth_50") > r["breadth_up"]), "TREND_UP")
        .when(strong & holds(~F.col("above_ema50")) & holds(F.col("breadth_50") < r["breadth_down"]), "TREND_DOWN")
        .when(holds(F.col("index_adx14") < r["adx_range"]), "RANGE")
        .otherwise("MIXED")
    )
    f = f.withColumn("state", state)
    size = F.coalesce(*[F.when(F.col("state") == s, m) for s, m in MULTIPLIER.items()])
    return f.withColumn("multiplier", size)


def zones(bars: DataFrame, lookback: int = 120, half: int = 2, tolerance: float = 0.01, touches: int = 3, span: int = 10) -> DataFrame:
    """``key, zone, touches``: prices where a key's recent pivots cluster.

    A pivot is a high or low that is extreme within ``half`` bars to both sides; clusters
    grow from their lowest pivot within the tolerance.
    """
    w = Window.partitionBy("key").orderBy("bucket")
    near = w.rowsBetween(-half, half)
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("bucket"))) <= lookback
    b = bars.select("key", "bucket", "high", "low", last.alias("_keep")).where("_keep")
    b = b.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(near)}).withColumns({"_h": F.max("high").over(near), "_l": F.min("low").over(near)})
    full = F.col("_n") == 2 * half + 1
    pivots = F.array_compact(F.array(F.when(full & (F.col("high") == F.col("_h")), F.col("high")), F.when(full & (F.col("low") == F.col("_l")), F.col("low"))))
    p = b.select("key", "_i", F.explode(pivots).alias("price"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["price", "_i"])
        out, group = [], []
        for price, i in [*zip(pdf["price"], pdf["_i"]), (np.inf, 0)]:
            if group and price > group[0][0] * (1 + tolerance):
                at = [j for _, j in group]
                if len(group) >= touches and max(at) - min(at) >= span:
                    out.append((pdf["key"].iloc[0], float(np.mean([x for x, _ in group])), len(group)))
                group = []
            group.append((price, i))
        return pd.DataFrame(out, columns=["key", "zone", "touches"])

    return p.groupBy("key").applyInPandas(cluster, "key string, zone double, touches long")


def sequential_book(candidates: DataFrame, equity: float, max_open: int = 5, sector_cap: int = 2, open_risk: float = 0.02, daily_loss: float = 0.02) -> DataFrame:
    """Admit candidates of each (strategy, session) in order of entry under the book's caps: ``strategy, session, trade_id, taken, skip, net``.

    ``candidates``: strategy, session, trade_id, entry_at, exit_at (seconds; null where no bar
    followed), priority, sector, qty, risk (money), net (money), exit_reason, halt_after_stop.
    A realised daily loss halts the rest of the session, and so does, where asked for, a
    first stop; a candidate is skipped when its size is nothing, too many trades or too much
    risk is open, its sector is full, or no bar follows it.

    Each session's candidates pass through one task in order, batch by batch; the state holds the
    open trades only, ``max_open`` at most, so the work is linear and no session is held whole.
    """
    c = candidates.select(
        F.col("strategy").cast("string"), F.col("session").cast("string"), F.col("entry_at").cast("long").alias("entry_at"), (-F.col("priority")).alias("low"), F.col("trade_id").cast("long").alias("trade_id"), F.col("exit_at").cast("long").alias("exit_at"), F.col("sector").cast("string").alias("sector"),
        F.col("qty").cast("long").alias("qty"), F.col("risk").cast("double").alias("risk"), F.col("net").cast("double").alias("net"), F.col("exit_reason").isin("STOP", "STOP_GAP").alias("stopped"), F.coalesce("halt_after_stop", F.lit(False)).alias("halt"),
    )
    ordered = c.repartition("strategy", "session").sortWithinPartitions(*c.columns).drop("low")
    least, most = -daily_loss * equity, open_risk * equity + 1e-6

    def admit(batches):
        import pyarrow as pa

        book, day = None, None
        for batch in batches:
            taken, skips, nets = [], [], []
            rows = zip(*(batch.column(n).to_pylist() for n in ("strategy", "session", "entry_at", "exit_at", "sector", "qty", "risk", "net", "stopped", "halt")))
            for strategy, session, *row in rows:
                if book is None or day != (strategy, session):
                    book, day = _Book(least, most, max_open, sector_cap), (strategy, session)
                skip = book.admit(*row)
                taken.append(skip is None)
                skips.append(skip)
                nets.append(row[5] if skip is None else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("strategy"), batch.column("session"), batch.column("trade_id"), pa.array(taken, pa.bool_()), pa.array(skips, pa.string()), pa.array(nets, pa.float64())], names=["strategy", "session", "trade_id", "taken", "skip", "net"])

    return ordered.mapInArrow(admit, "strategy string, session string, trade_id long, taken boolean, skip string, net double")


def _or(a: bool | None, b: bool | None) -> bool | None:
    """SQL's OR: true if either is, unknown if one is unknown."""
    return True if a or b else None if a is None or b is None else False


class _Book:
    """The state of one session's book; nulls count as in SQL, and NaN is above every number."""

    def __init__(self, least: float, most: float, max_open: int, sector_cap: int):
        self.least, self.most, self.max_open, self.sector_cap = least, most, max_open, sector_cap
        self.halted, self.stopped, self.realised, self.open = False, False, 0.0, []

    def admit(self, entry_at, exit_at, sector, qty, risk, net, stopped, halt) -> str | None:
        """Why the candidate is skipped; null if it is taken."""
        ended = [t for t in self.open if entry_at is not None and t[0] <= entry_at]
        self.open = [t for t in self.open if entry_at is not None and t[0] > entry_at]
        if ended:
            self.realised = _sum(self.realised, _sum(0.0, *(t[3] for t in ended)))
            for t in ended:
                self.stopped = _or(self.stopped, t[4])
        self.halted = _or(self.halted, None if self.realised is None else self.realised <= self.least)
        at_risk = _sum(_sum(0.0, *(t[1] for t in self.open)), risk)
        if self.halted:
            return "HALT_DAILY"
        if halt and self.stopped:
            return "HALT_FIRST_STOP"
        if qty is not None and qty <= 0:
            return "CAP_LIQUIDITY"
        if len(self.open) >= self.max_open or (at_risk is not None and (at_risk > self.most or at_risk != at_risk)):
            return "CAP_OPEN_RISK"
        if sum(sector is not None and t[2] == sector for t in self.open) >= self.sector_cap:
            return "CAP_SECTOR"
        if exit_at is None:
            return "NO_INTRADAY_BARS"
        self.open.append((exit_at, risk, sector, net, stopped))
        return None


def _sum(*values: float | None) -> float | None:
    return None if any(v is None for v in values) else sum(values[1:], values[0])


def tranche_book(picks: DataFrame, opens: DataFrame, h: int = 5) -> DataFrame:
    """Daily returns of h staggered equal-weight tranches: ``arm, session_idx, ret, bought, sold, positions, missing``.

    ``picks``: arm, session_idx, key.  ``opens``: session_idx (dense), key, open (rows only where there was
    one).  A tranche holds its picks from open to open over h sessions and then gives its money to the next of
    its row; a pick without an open is left out; a held name without one keeps its last worth and is counted
    in ``missing``; money that finds no name to buy stays cash.  Sessions run from an arm's first pick to the last open.

    What a name of a tranche is worth relates to its first open alone, and a tranche's money is the
    product of what its row has made before, so all is joins, running products and sums: no chain of days
    is walked, and rows are names times h.
    """
    price = opens.where("open > 0").select("session_idx", "key", "open")
    last = price.agg(F.max("session_idx").alias("end"))
    first = picks.groupBy("arm").agg(F.min("session_idx").alias("begin")).join(F.broadcast(last))  # one row
    days = first.select("arm", "begin", "end", F.explode(F.sequence("begin", F.col("end") - 1)).alias("s"))
    bought = picks.select("arm", F.col("session_idx").alias("s"), "key").distinct().join(price.select(F.col("session_idx").alias("s"), "key", F.col("open").alias("base")), ["s", "key"])
    # worth of a name, as a multiple of what it cost, at each session of its tranche
    held = bought.withColumn("t", F.explode(F.sequence("s", F.col("s") + h)))
    held = held.join(price.select(F.col("session_idx").alias("t"), "key", "open"), ["t", "key"], "left").join(F.broadcast(last)).where("t <= end").drop("end")
    seen = F.last("open", ignorenulls=True).over(Window.partitionBy("arm", "s", "key").orderBy("t"))
    held = held.withColumns({"multiple": seen / F.col("base"), "absent": F.col("open").isNull()})
    grown = held.where(F.col("t") == F.col("s") + h).groupBy("arm", "s").agg(F.avg("multiple").alias("growth"))
    names = bought.groupBy("arm", "s").agg(F.count("*").alias("names"))
    rows = days.join(names, ["arm", "s"], "left").join(grown, ["arm", "s"], "left")
    past = Window.partitionBy("arm", F.pmod(F.col("s") - F.col("begin"), F.lit(h))).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    capital = F.exp(F.coalesce(F.sum(F.log("growth")).over(past), F.lit(0.0))) / h * F.when(F.coalesce(F.count_if(F.col("names").isNull()).over(past), F.lit(0)) == 0, 1.0).otherwise(0.0)
    rows = rows.withColumn("capital", capital)
    idle = F.sum(F.when(F.col("names").isNull(), F.col("capital")).otherwise(0.0)).over(Window.partitionBy("arm").orderBy("s"))
    rows = rows.withColumn("cash", idle + F.greatest(F.lit(0), F.lit(h) - (F.col("s") - F.col("begin") + 1)) / F.lit(float(h)))
    worth = held.join(rows.where("names IS NOT NULL").select("arm", "s", (F.col("capital") / F.col("names")).alias("each")), ["arm", "s"]).withColumn("worth", F.col("each") * F.col("multiple"))
    # of a name on a session: before that session's trades, after them, and at the next open
    at = worth.select("arm", F.col("t").alias("d"), "key", F.when(F.col("t") > F.col("s"), F.col("worth")).alias("before"), F.when(F.col("t") < F.col("s") + h, F.col("worth")).alias("after"), F.lit(None).cast("double").alias("next"), F.lit(0).alias("miss"))
    after = worth.where("t > s").select("arm", (F.col("t") - 1).alias("d"), "key", F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"), F.col("worth").alias("next"), F.col("absent").cast("int").alias("miss"))
    by_name = at.union(after).groupBy("arm", "d", "key").agg(F.coalesce(F.sum("before"), F.lit(0.0)).alias("before"), F.sum("after").alias("after"), F.sum("next").alias("next"), F.sum("miss").alias("miss"))
    move = F.coalesce("after", F.lit(0.0)) - F.col("before")
    daily = by_name.groupBy("arm", "d").agg(
        F.sum("after").alias("after"), F.sum("next").alias("next"), F.sum(F.greatest(move, F.lit(0.0))).alias("up"), F.sum(F.greatest(-move, F.lit(0.0))).alias("down"), F.count("after").alias("positions"), F.sum("miss").alias("missing")
    )
    both = rows.select("arm", F.col("s").alias("d"), "cash").join(daily, ["arm", "d"], "left").na.fill(0, ["after", "next", "up", "down", "positions", "missing"])
    total = F.col("after") + F.col("cash")
    return both.select("arm", F.col("d").alias("session_idx"), ((F.col("next") + F.col("cash")) / total - 1).alias("ret"), (F.col("up") / total).alias("bought"), (F.col("down") / total).alias("sold"), "positions", "missing")
