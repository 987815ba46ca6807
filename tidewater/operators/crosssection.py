"""Cross-section research over a panel (key, i, open, high, low, close, volume), i the dense index of the session.

A panel has no rows for sessions that a key missed, so "n sessions ago" is a range of ``i``,
never a count of rows.  All signals of a key share one partitioning and one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ranks import bins
from .stats import draw_number


def _sessions(first: int, last: int) -> WindowSpec:
    return Window.partitionBy("key").orderBy("i").rangeBetween(first, last)


def ago(column: str, n: int) -> Column:
    """The value exactly n sessions before; null where that session is missing or its value is not positive."""
    return F.max(F.when(F.col(column) > 0, F.col(column))).over(_sessions(-n, -n))


def momentum(lookback: int = 252, skip: int = 21) -> Column:
    """The return from ``lookback`` to ``skip`` sessions before."""
    return ago("close", skip) / ago("close", lookback) - 1


def high_proximity(lookback: int = 252) -> Column:
    """The close over the highest high of ``lookback`` sessions; null before the panel is as long."""
    top = F.max(F.when(F.col("high") > 0, F.col("high"))).over(_sessions(-(lookback - 1), 0))
    return F.when((F.col("i") >= lookback - 1) & (F.col("close") > 0), F.col("close") / top)


def gap() -> Column:
    return F.when(F.col("open") > 0, F.col("open")) / ago("close", 1) - 1


def volume_spike(window: int = 20, times: float = 1.5) -> Column:
    """Whether the last session's volume was over ``times`` the mean of the ``window`` before it."""
    before = _sessions(-1 - window, -2)
    last = F.max("volume").over(_sessions(-1, -1))
    enough = F.count("volume").over(before) >= window // 2
    return F.coalesce(enough & (last > times * F.avg("volume").over(before)), F.lit(False))


def gap_and_go(window: int = 20, times: float = 1.5) -> Column:
    return F.when(volume_spike(window, times), gap())


def locked() -> Column:
    """A session without a tradable range."""
    return F.coalesce(F.col("high") == F.col("low"), F.lit(True)) | (F.col("high") <= 0) | (F.col("low") <= 0)


def suspect(exact: Column | None = None, threshold: float = 0.25) -> Column:
    """A session whose open or close moved too far from the previous close, without an exact factor, or has a price that is not positive."""
    before = ago("close", 1)
    far = (F.abs(F.col("close") / before - 1) > threshold) | (F.abs(F.col("open") / before - 1) > threshold)
    known = F.coalesce(exact, F.lit(False)) if exact is not None else F.lit(False)
    present = F.col("close").isNotNull() & F.col("open").isNotNull()
    return F.coalesce(present & ((F.col("close") <= 0) | (F.col("open") <= 0) | (far & ~known)), F.lit(False))


def median_turnover(n: int = 20) -> Column:
    value = F.when((F.col("close") > 0) & (F.col("volume") >= 0), F.col("close") * F.col("volume"))
    frame = _sessions(-(n - 1), 0)
    seen = F.sort_array(F.collect_list(value).over(frame))  # n values at most
    middle = lambda k: F.get(seen, F.floor((F.size(seen) - k) / 2).cast("int"))
    return F.when(F.size(seen) >= n // 2, (middle(1) + middle(0)) / 2)


def log_volatility(n: int = 60) -> Column:
    """Population deviation of the log steps between the valid closes of the last n + 1 sessions."""
    valid = F.col("close") > 0
    at = F.when(valid, F.log("close"))
    before = F.last(at, ignorenulls=True).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    square = F.when(valid, F.coalesce(F.pow(at - before, 2), F.lit(0.0)))
    frame = _sessions(-n, 0)
    steps = F.count(at).over(frame) - 1
    # the first close of the frame has its step outside of it; the sum of the others is the way from it to the last
    squares = F.sum(square).over(frame) - F.first(square, ignorenulls=True).over(frame)
    mean = (F.last(at, ignorenulls=True).over(frame) - F.first(at, ignorenulls=True).over(frame)) / steps
    return F.when((steps + 1 >= n // 2) & (steps > 1), F.sqrt(F.greatest(squares / steps - mean * mean, F.lit(0.0))))


def eligible(panel: DataFrame, exact: Column | None = None, top: int = 200, min_history: int = 252, min_price: float = 20.0, lookback: int = 252, threshold: float = 0.25, turnover_window: int = 20, vol_window: int = 60) -> DataFrame:
    """``i, key, turnover, volatility, place``: the names that may be traded after a session, by turnover.

    A name needs a price, enough valid closes up to then, turnover and volatility, and no
    suspect session within the lookback.
    """
    marked = panel.withColumn("suspect", suspect(exact, threshold))
    rows = marked.select(
        "key", "i", "close",
        F.count(F.when(F.col("close") > 0, 1)).over(_sessions(Window.unboundedPreceding, 0)).alias("history"),
        F.max("suspect").over(_sessions(-(lookback - 1), 0)).alias("tainted"),
        median_turnover(turnover_window).alias("turnover"), log_volatility(vol_window).alias("volatility"),
    )
    good = rows.where((F.col("close") >= min_price) & (F.col("history") >= min_history) & ~F.col("tainted") & F.col("turnover").isNotNull() & F.col("volatility").isNotNull())
    order = Window.partitionBy("i").orderBy(F.desc("turnover"), "key")
    return good.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("i", "key", "turnover", "volatility", "place")


def month_plan(sessions: DataFrame, day: str = "day", index: str = "i") -> DataFrame:
    """``formation, entry, exit``: a month's last session, the next one, and the first of the month after; calendar rows only."""
    w = Window.orderBy(day)  # a calendar
    firsts = sessions.withColumn("_before", F.lag(day).over(w)).where(F.date_trunc("month", day) > F.date_trunc("month", "_before"))
    return firsts.select((F.col(index) - 1).alias("formation"), F.col(index).alias("entry"), F.lead(index).over(w).alias("exit")).where("exit IS NOT NULL")


def matched_controls(rows: DataFrame, by: list[str], cell: list[str], seed: int, exclude: str | None = None) -> DataFrame:
    """``by, key, control``: for every ``picked`` row one row of its cell that was not, none twice; null where the cell has none left.

    Both sides of a cell are put in order, the pool by a hash, and meet by number: a sampled
    join without replacement that needs no state.
    """
    numbered = lambda df, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *cell).orderBy(*order)))
    chosen = numbered(rows.where("picked"), F.col("key")).select(*by, *cell, "_n", "key")
    free = rows.where(~F.col("picked") & (~F.col(exclude) if exclude else F.lit(True)))
    pool = numbered(free, draw_number(seed, *[F.col(c) for c in by], F.col("key")), F.col("key")).select(*by, *cell, "_n", F.col("key").alias("control"))
    return chosen.join(pool, [*by, *cell, "_n"], "left").select(*by, "key", "control")


def form_arms(universe: DataFrame, score: str, k: int, seed: int, turnover_bins: int = 10, vol_bins: int = 10) -> DataFrame:
    """``i, arm, key`` of every session's arms, formed without a look at any return.

    P has the k best scores, C2 a matched control for each, PL as many random other names,
    PLC their matched controls outside of P, C0 the whole universe.
    """
    by = ["i"]
    u = universe.withColumns({"cell_t": bins("turnover", by, turnover_bins), "cell_v": bins("volatility", by, vol_bins)})
    best = Window.partitionBy("i").orderBy(F.desc_nulls_last(score), "key")
    u = u.withColumn("picked", (F.row_number().over(best) <= k) & F.col(score).isNotNull())
    size = F.count_if("picked").over(Window.partitionBy("i"))
    lot = Window.partitionBy("i").orderBy("picked", draw_number(seed, F.lit("placebo"), F.col("i"), F.col("key")), "key")
    u = u.withColumn("placebo", ~F.col("picked") & (F.row_number().over(lot) <= size))
    cell = ["cell_t", "cell_v"]
    arm = lambda df, name, key="key": df.select("i", F.lit(name).alias("arm"), F.col(key).alias("key"))
    c2 = matched_controls(u, by, cell, seed).where("control IS NOT NULL")
    plc = matched_controls(u.withColumns({"in_p": F.col("picked"), "picked": F.col("placebo")}), by, cell, seed + 1, "in_p").where("control IS NOT NULL")
    parts = [arm(u.where("picked"), "P"), arm(c2, "C2", "control"), arm(u.where("placebo"), "PL"), arm(plc, "PLC", "control"), arm(u, "C0")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arm_returns(arms: DataFrame, returns: DataFrame) -> DataFrame:
    """``i, arm, gross, names``: equal-weight return of each arm's names that have one (returns: i, key, r)."""
    return arms.join(returns.where("r IS NOT NULL"), ["i", "key"]).groupBy("i", "arm").agg(F.avg("r").alias("gross"), F.count("*").alias("names"))


def primary_series(gross: DataFrame, costs: DataFrame) -> DataFrame:
    """``i, p_gross, c2_gross, cost, s, placebo, c0_gross``: picks less costs and controls; the placebo is gross (costs: i, cost)."""
    of = lambda a: F.max(F.when(F.col("arm") == a, F.col("gross")))
    wide = gross.groupBy("i").agg(of("P").alias("p_gross"), of("C2").alias("c2_gross"), of("PL").alias("_pl"), of("PLC").alias("_plc"), of("C0").alias("c0_gross"))
    both = wide.join(costs, "i", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    return both.select("i", "p_gross", "c2_gross", "cost", (F.col("p_gross") - F.col("cost") - F.col("c2_gross")).alias("s"), (F.col("_pl") - F.col("_plc")).alias("placebo"), "c0_gross")


def breadth(panel: DataFrame, mean_of: int = 50, extremes_of: int = 20) -> DataFrame:
    """Per session: advances, declines, unchanged, share above the mean, advance ratio, and new highs less new lows per name."""
    w = Window.partitionBy("key").orderBy("i")
    back = lambda n: w.rowsBetween(-(n - 1), 0)
    valid = panel.where("close > 0")
    n = F.row_number().over(w)
    c, before = F.col("close"), F.lag("close").over(w)
    flags = valid.select(
        "i", F.when(n >= mean_of, c > F.avg("close").over(back(mean_of))).alias("above"), (c > before).alias("up"), (c < before).alias("down"), (c == before).alias("same"),
        F.when(n >= extremes_of, c >= F.max("close").over(back(extremes_of))).alias("high"), F.when(n >= extremes_of, c <= F.min("close").over(back(extremes_of))).alias("low"),
    )
    got = flags.groupBy("i").agg(
        F.count("*").alias("names"), F.count_if("up").alias("advances"), F.count_if("down").alias("declines"), F.count_if("same").alias("unchanged"),
        F.avg(F.col("above").cast("int")).alias("above_mean"), F.count_if("high").alias("_h"), F.count_if("low").alias("_l"),
    )
    moved = F.col("advances") + F.col("declines")
    return got.withColumns({"ad_ratio": F.when(moved > 0, F.col("advances") / moved), "nh_nl": (F.col("_h") - F.col("_l")) / F.col("names")}).drop("_h", "_l")


def regular_sessions(slots: DataFrame, index_key: str, count: int) -> DataFrame:
    """The sessions in which the reference index has all ``count`` slots (slots: key, i, slot, open, high, low, close, volume)."""
    return slots.where((F.col("key") == index_key) & F.col("close").isNotNull()).groupBy("i").agg(F.count_distinct("slot").alias("_n")).where(F.col("_n") == count).select("i")


def open_consistent(slots: DataFrame, daily: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``key, i, consistent``: whether the first slot's open agrees with the official one."""
    first = slots.where("slot = 0 AND open > 0").select("key", "i", F.col("open").alias("_o"))
    return first.join(daily.where("open > 0").select("key", "i", "open"), ["key", "i"]).select("key", "i", (F.abs(F.col("_o") / F.col("open") - 1) <= tolerance).alias("consistent"))


def first_slot_signals(slots: DataFrame, regular: DataFrame, window: int = 20, least: int = 15) -> DataFrame:
    """``key, i, first_return, relative_volume``: of the first slot, against its volumes in the ``window`` regular sessions before."""
    order = Window.orderBy("i")  # a calendar
    axis = regular.withColumn("r", F.row_number().over(order))
    days = slots.select("i").distinct().join(regular.withColumn("_reg", F.lit(1)), "i", "left").withColumn("seen", F.coalesce(F.sum("_reg").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("i", "seen")
    first = slots.where("slot = 0 AND open > 0").select("key", "i", "open", "close", "volume")
    base = first.join(F.broadcast(axis), "i").select("key", F.col("r").alias("seen"), "volume")  # one row per regular session and key
    here = first.join(F.broadcast(days), "i")
    both = base.withColumn("_side", F.lit(0)).unionByName(here.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    past = Window.partitionBy("key").orderBy("seen").rangeBetween(-(window - 1), 0)
    old = F.when(F.col("_side") == 0, F.col("volume"))
    both = both.withColumns({"_n": F.count(old).over(past), "_m": F.avg(old).over(past)})
    usable = (F.col("seen") >= window) & (F.col("_n") >= least) & (F.col("_m") > 0)
    return both.where("_side = 1").select("key", "i", F.when(F.col("close") > 0, F.col("close") / F.col("open") - 1).alias("first_return"), F.when(usable, F.col("volume") / F.col("_m")).alias("relative_volume"))


def session_exits(entries: DataFrame, slots: DataFrame, first: int, last: int, mult: float = 1.0) -> DataFrame:
    """``key, i, time_exit, exit, how``: the exit by time, and by target or stop before it (entries: key, i, entry, sigma).

    By time: the open of slot ``last``, else the close of the latest slot from ``first`` on before it.
    Target and stop lie ``mult`` * sigma from the entry; the first slot before ``last`` that
    touches one decides, the stop if both; a slot that opens beyond the level fills at its open.
    """
    s = entries.join(slots.where((F.col("slot") <= last) & (F.col("open") > 0)), ["key", "i"])
    target, stop = F.col("entry") * (1 + mult * F.col("sigma")), F.col("entry") * (1 - mult * F.col("sigma"))
    early = F.col("slot") < last
    touch = early & ((F.col("low") <= stop) | (F.col("high") >= target))
    how = F.when((F.col("low") <= stop) & (F.col("high") >= target), "both").when(F.col("low") <= stop, "stop").otherwise("target")
    fill = F.when(F.col("low") <= stop, F.least(stop, F.col("open"))).otherwise(F.greatest(target, F.col("open")))
    got = s.groupBy("key", "i").agg(
        F.max(F.when(F.col("slot") == last, F.col("open"))).alias("_at"), F.max_by("close", F.when(early & (F.col("slot") >= first) & (F.col("close") > 0), F.col("slot"))).alias("_before"),
        F.min_by(F.struct(fill.alias("px"), how.alias("how")), F.when(touch, F.col("slot"))).alias("_t"), F.min(F.when(touch, F.col("slot"))).alias("_slot"), F.max(F.when(early & (F.col("slot") >= first) & (F.col("close") > 0), 1)).alias("_any"),
    )
    time = F.coalesce("_at", F.when(F.col("_any") == 1, F.col("_before")))
    return got.select("key", "i", time.alias("time_exit"), F.when(F.col("_slot").isNull(), time).otherwise(F.col("_t.px")).alias("exit"), F.when(F.col("_slot").isNull(), "time").otherwise(F.col("_t.how")).alias("how"))


def select_models(scored: DataFrame, by: list[str], cost: Column, k: int) -> DataFrame:
    """The k best expected returns that beat their cost, with a probability over one half and no results that day."""
    ok = scored.where((F.col("exp_return") > cost) & (F.col("prob") > 0.5) & ~F.coalesce("results_today", F.lit(False)))
    return ok.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("exp_return"), "key"))).where(F.col("place") <= k)
