"""Features from statements, flows and events: growth and leverage from a JSON statement, net flows, own ratios, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import DIVISION_UNDEFINED, INSUFFICIENT_HISTORY, MALFORMED_INPUT, MISSING_INPUT, NOT_APPLICABLE, result
from ..functions.scalars import parse_number, parse_period
from .pit import latest_by

STATEMENT = "struct<full_statement:array<struct<particular:string,history:array<struct<period:string,value:string>>>>>"
VERDICT_SCORE = {"BEAT": 1.0, "MISS": -1.0, "INLINE": 0.0, "MIXED": 0.0}


def statement_line(payload: Column, particular: str) -> Column:
    """The (period, value) of one line of a JSON statement, oldest first; null if it is malformed, empty if there is no such line."""
    rows = F.from_json(payload, STATEMENT)["full_statement"]
    line = F.try_element_at(F.filter(rows, lambda r: r["particular"] == particular), F.lit(1))
    points = F.transform(line["history"], lambda h: F.struct(parse_period(h["period"]).alias("period"), parse_number(h["value"]).alias("value")))
    good = F.array_sort(F.filter(points, lambda p: p["period"].isNotNull() & p["value"].isNotNull()))
    empty = F.array().cast("array<struct<period:date,value:double>>")
    return F.when(rows.isNull(), F.lit(None)).when(line.isNull(), empty).otherwise(good)


def growth(line: Column, payload: Column, quarterly: bool = False) -> Column:
    """The latest period over the one before, or, ``quarterly``, over the same quarter a year earlier.

    Quarters that all lie a year or more apart are annual figures with a wrong label: malformed.
    """
    n = F.size(line)
    last = F.get(line, n - 1)
    month = lambda p: F.year(p) * 12 + F.month(p)
    if quarterly:
        base = F.get(F.filter(line, lambda x: month(x["period"]) == month(last["period"]) - 12), F.lit(0))
        gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: month(F.get(line, i)["period"]) - month(F.get(line, i - 1)["period"]))
        short = (n < 2) | base.isNull()
        annual = F.when(n >= 2, F.array_min(gaps) >= 12).otherwise(False)
    else:
        base, short, annual = F.get(line, n - 2), n < 2, F.lit(False)
    return result(
        last["value"] / F.nullif(base["value"], F.lit(0.0)) - 1,
        (payload.isNull(), MISSING_INPUT), (line.isNull(), MALFORMED_INPUT), (n == 0, MISSING_INPUT), (annual, MALFORMED_INPUT), (short, INSUFFICIENT_HISTORY), (base["value"] <= 0, DIVISION_UNDEFINED),
    )


def liabilities_to_assets(payload: Column) -> Column:
    """Current and non-current liabilities over total assets, of the latest period of the assets."""
    now, later, total = (statement_line(payload, p) for p in ("Current Liabilities", "Non-Current Liabilities", "Total Assets"))
    last = F.get(total, F.size(total) - 1)
    at = lambda line: F.get(F.filter(line, lambda x: x["period"] == last["period"]), F.lit(0))["value"]
    absent = at(now).isNull() | at(later).isNull()
    return result(
        (at(now) + at(later)) / F.nullif(last["value"], F.lit(0.0)),
        (payload.isNull(), MISSING_INPUT), (now.isNull() | later.isNull() | total.isNull(), MALFORMED_INPUT), (F.size(total) == 0, MISSING_INPUT), (absent, MISSING_INPUT), (last["value"] <= 0, DIVISION_UNDEFINED),
    )


def net_flows(series: DataFrame, who: str) -> DataFrame:
    """``day, net, one_sided``: what an investor group bought less what it sold, per day (series: series_code, day, value)."""
    mine = series.where(F.col("series_code").startswith(f"{who}|NSE_EQ|CASH|1D|"))
    side = F.substring_index("series_code", "|", -1)
    of = lambda s: F.max(F.when(side == s, F.col("value").cast("double")))
    both = mine.where(side.isin("buy_amt", "sell_amt")).groupBy("day").agg(of("buy_amt").alias("_b"), of("sell_amt").alias("_s"))
    return both.select("day", (F.col("_b") - F.col("_s")).alias("net"), (F.col("_b").isNull() | F.col("_s").isNull()).alias("one_sided"))


def flow_feature(flows: DataFrame, n: int, previous_session: Column) -> DataFrame:
    """One row ``flow``: the sum of the last n days' net flows, of which the latest has to be the previous session; a day with one side only makes all of it malformed."""
    # the top n of one series and one aggregate: no row stays
    last = flows.orderBy(F.desc("day")).limit(n)
    state = flows.agg(F.count("*").alias("_c"), F.bool_or("one_sided").alias("_bad"), F.max("day").alias("_last"))
    total = last.agg(F.sum("net").alias("_n"), F.count("net").alias("_k"))
    rules = ((F.col("_c") == 0, MISSING_INPUT), (F.coalesce("_bad", F.lit(False)), MALFORMED_INPUT), (F.col("_last") != previous_session, MISSING_INPUT), (F.col("_k") < n, INSUFFICIENT_HISTORY))
    return state.join(total).select(result(F.col("_n"), *rules).alias("flow"))


def own_ratios(quarters: DataFrame, years: DataFrame, prices: DataFrame, actions: DataFrame, session: Column, unit: float = 1e7) -> DataFrame:
    """``key`` with pe_ttm, earnings_yield_ttm, pb_own, eps_surprise_srw, eps_surprise_srw_price as (value, reason) structs.

    ``quarters``: key, period, profit; ``years``: key, period, profit, eps, book; ``prices``: key, price.
    Shares are profit over profit per share of the latest year where both have one sign; a split or bonus
    (``actions``: key, kind, ex_date) with its ex-date behind that year's end and up to the session
    changes their number, so what needs it is MISSING_INPUT then.  Trailing profit needs four quarters in a row.
    """
    from .fundamentals import trailing

    ttm = trailing(quarters.select("key", F.lit("p").alias("item"), "period", F.col("profit").alias("value")), "p").select("key", "period", "ttm")
    good = years.where(F.col("profit") * F.col("eps") > 0)
    shares = latest_by(good.select("key", "period", "profit", "eps"), ["key"], ["period"]).select("key", F.col("period").alias("_year_end"), (F.col("profit") * unit / F.col("eps")).alias("_shares"))
    latest = actions.where(F.col("kind").isin("SPLIT", "BONUS") & (F.col("ex_date") <= session)).groupBy("key").agg(F.max("ex_date").alias("_changed"))
    shares = shares.join(latest, "key", "left").select("key", F.when(F.col("_changed").isNull() | (F.col("_changed") <= F.col("_year_end")), F.col("_shares")).alias("shares"))
    book = latest_by(years.where("book IS NOT NULL").select("key", "period", "book"), ["key"], ["period"]).select("key", "book")
    last = latest_by(quarters.select("key", "period", "profit"), ["key"], ["period"])
    before = quarters.select("key", F.last_day(F.add_months("period", 12)).alias("period"), F.col("profit").alias("_base"))
    step = last.join(before, ["key", "period"], "left").select("key", F.col("profit").alias("_q"), "_base")
    b = prices.join(ttm.drop("period"), "key", "left").join(shares, "key", "left").join(book, "key", "left").join(step, "key", "left")
    eps = F.col("ttm") * unit / F.col("shares")
    none, few = (F.col("shares").isNull(), MISSING_INPUT), (F.col("ttm").isNull(), INSUFFICIENT_HISTORY)
    unpriced = (F.col("price").isNull(), MISSING_INPUT)
    bad = (F.col("price") <= 0, DIVISION_UNDEFINED)
    change = (F.col("_q") - F.col("_base")) * unit / F.col("shares")
    return b.select(
        "key",
        result(F.col("price") / F.nullif(eps, F.lit(0.0)), none, few, unpriced, (eps <= 0, DIVISION_UNDEFINED)).alias("pe_ttm"),
        result(eps / F.nullif("price", F.lit(0.0)), none, few, unpriced, bad).alias("earnings_yield_ttm"),
        result(F.col("price") * F.col("shares") / F.nullif(F.col("book") * unit, F.lit(0.0)), none, unpriced, (F.col("book").isNull(), MISSING_INPUT), (F.col("book") <= 0, DIVISION_UNDEFINED)).alias("pb_own"),
        result((F.col("_q") - F.col("_base")) / F.nullif(F.abs("_base"), F.lit(0.0)), (F.col("_q").isNull(), MISSING_INPUT), (F.col("_base").isNull(), INSUFFICIENT_HISTORY), (F.col("_base") == 0, DIVISION_UNDEFINED)).alias("eps_surprise_srw"),
        result(change / F.nullif("price", F.lit(0.0)), (F.col("_q").isNull(), MISSING_INPUT), (F.col("_base").isNull(), INSUFFICIENT_HISTORY), none, unpriced, bad).alias("eps_surprise_srw_price"),
    )


def street_verdicts(events: DataFrame, keys: DataFrame, instant: Column, covered: Column, days: int = 90) -> DataFrame:
    """``key, street_verdict_90d``: the score of each key's latest verdict of the window (events: key, verdict, known_at, event_id)."""
    age = (F.unix_micros(instant.cast("timestamp")) - F.unix_micros(F.col("known_at").cast("timestamp"))) / 8.64e10
    seen = events.where((F.col("known_at") < instant) & (age <= days) & F.col("verdict").isin(*VERDICT_SCORE))
    last = latest_by(seen.select("key", "known_at", "event_id", "verdict"), ["key"], ["known_at", "event_id"])
    score = F.when(F.col("verdict") == "BEAT", 1.0).when(F.col("verdict") == "MISS", -1.0).otherwise(0.0)
    b = keys.select("key").distinct().join(last, "key", "left")
    return b.select("key", result(score, (~covered, MISSING_INPUT), (F.col("verdict").isNull(), NOT_APPLICABLE)).alias("street_verdict_90d"))


def linked_news(links: DataFrame, keys: DataFrame, instant: Column) -> DataFrame:
    """``key, news_count_24h, news_count_7d, news_hours_since_last`` by publication time of what was knowable (links: key, published_at, knowable_at)."""
    age = (F.unix_micros(instant.cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 3.6e9
    seen = links.where(F.col("knowable_at") < instant).withColumn("_a", age)
    n = seen.groupBy("key").agg(F.count_if(F.col("_a") <= 24).alias("_d"), F.count_if(F.col("_a") <= 168).alias("_w"), F.min("_a").alias("_l"))
    b = keys.select("key").distinct().join(n, "key", "left")
    count = lambda c: result(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return b.select("key", count("_d").alias("news_count_24h"), count("_w").alias("news_count_7d"), result(F.col("_l"), (F.col("_l").isNull(), NOT_APPLICABLE)).alias("news_hours_since_last"))


def forensic(ratios: DataFrame) -> DataFrame:
    """Adds ``red`` and ``green``: the names of the rules that a company's figures meet.

    Columns: pe, pe_sector, roe (percent), liabilities_to_assets, pat_yoy, pat_yoy_q, eps_surprise,
    promoter_change, pledged (points). A sector figure over 150 or not positive is not compared.
    """
    c = F.col
    sane = c("pe_sector").between(0, 150) & (c("pe_sector") > 0)
    red = [
        ((c("pe_sector") > 150) | (c("pe_sector") <= 0), "SECTOR_PE_IMPLAUSIBLE"), (c("pe") < 0, "NEGATIVE_EARNINGS"), (sane & (c("pe") >= 0) & (c("pe") > 2 * c("pe_sector")), "PE_TWICE_SECTOR"), (c("roe") < 5, "LOW_ROE"),
        (c("liabilities_to_assets") > 0.8, "HIGH_LIABILITIES"), (c("pat_yoy") <= -0.3, "YEARLY_PROFIT_DOWN"), (c("pat_yoy_q") <= -0.3, "QUARTERLY_PROFIT_DOWN"), (c("eps_surprise") <= 0, "EPS_BELOW_YEAR_AGO"),
        (c("promoter_change") <= -2, "PROMOTERS_DOWN"), (c("pledged") > 10, "PLEDGED"),
    ]
    green = [
        (sane & (c("pe") > 0) & (c("pe") < 0.7 * c("pe_sector")), "PE_BELOW_SECTOR"), (c("roe") >= 15, "HIGH_ROE"), (c("pat_yoy") >= 0.3, "YEARLY_PROFIT_UP"), (c("pat_yoy_q") >= 0.3, "QUARTERLY_PROFIT_UP"), (c("eps_surprise") > 0, "EPS_ABOVE_YEAR_AGO"),
        (c("promoter_change") >= 2, "PROMOTERS_UP"),
    ]
    listed = lambda rules: F.array_compact(F.array(*[F.when(k, n) for k, n in rules]))
    return ratios.withColumns({"red": listed(red), "green": listed(green)})
