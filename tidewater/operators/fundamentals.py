"""Fundamentals: merged statement histories, trailing sums, ratios, growth, surprise, vendor ratios, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reasons import DIVISION_UNDEFINED, MALFORMED_INPUT, MISSING_INPUT, result
from ..functions.scalars import parse_number, quarters_back
from .pit import latest_by


def merged(snapshots: DataFrame, instant: Column) -> DataFrame:
    """``key, item, period, value``: of every period the value known last before the instant.

    ``snapshots``: key, item, period (date), value, knowable_at, snapshot_id.
    """
    seen = snapshots.where((F.col("knowable_at") < instant) & F.col("value").isNotNull())
    return latest_by(seen.select("key", "item", "period", "knowable_at", "snapshot_id", "value"), ["key", "item", "period"], ["knowable_at", "snapshot_id"]).select("key", "item", "period", "value")


def trailing(values: DataFrame, item: str, n: int = 4) -> DataFrame:
    """``key, period, ttm``: the sum of each key's n latest quarters; null unless they follow one another."""
    q = values.where(F.col("item") == item)
    w = Window.partitionBy("key").orderBy(F.desc("period"))
    last = q.withColumns({"_r": F.row_number().over(w), "_last": F.max("period").over(Window.partitionBy("key"))}).where(F.col("_r") <= n)
    expected = F.coalesce(*[F.when(F.col("_r") == i + 1, quarters_back(F.col("_last"), i)) for i in range(n)])
    good = F.count_if(F.col("period") == expected) == n
    return last.groupBy("key").agg(F.max("period").alias("period"), F.when(good, F.sum("value")).alias("ttm"))


def year_on_year(values: DataFrame, item: str, months: int = 12) -> DataFrame:
    """``key, growth``: the latest period over the one a year before, a (value, reason) struct."""
    v = values.where(F.col("item") == item).select("key", "period", "value")
    latest = latest_by(v, ["key"], ["period"])
    before = v.select("key", F.last_day(F.add_months("period", months)).alias("period"), F.col("value").alias("_base"))
    both = latest.join(before, ["key", "period"], "left")
    return both.select("key", result(F.try_divide("value", "_base") - 1, (F.col("_base").isNull(), MISSING_INPUT), (F.col("_base") <= 0, DIVISION_UNDEFINED)).alias("growth"))


def surprise(values: DataFrame, item: str) -> DataFrame:
    """``key, surprise``: the latest quarter less the same of the year before, over the latter's size."""
    v = values.where(F.col("item") == item).select("key", "period", "value")
    latest = latest_by(v, ["key"], ["period"])
    before = v.select("key", F.last_day(F.add_months("period", 12)).alias("period"), F.col("value").alias("_base"))
    both = latest.join(before, ["key", "period"], "left")
    return both.select("key", result((F.col("value") - F.col("_base")) / F.abs("_base"), (F.col("_base").isNull(), MISSING_INPUT), (F.col("_base") == 0, DIVISION_UNDEFINED)).alias("surprise"))


def share_count(values: DataFrame, profit: str, per_share: str, unit: float = 1e7) -> DataFrame:
    """``key, fy, shares``: of the latest year where profit and profit per share agree in sign."""
    p = values.where(F.col("item") == profit).select("key", "period", F.col("value").alias("_p"))
    e = values.where(F.col("item") == per_share).select("key", "period", F.col("value").alias("_e"))
    good = p.join(e, ["key", "period"]).where((F.col("_p") * F.col("_e")) > 0)
    return latest_by(good, ["key"], ["period"]).select("key", F.col("period").alias("fy"), (F.col("_p") * unit / F.col("_e")).alias("shares"))


def price_ratios(ttm: DataFrame, shares: DataFrame, book: DataFrame, prices: DataFrame, unit: float = 1e7) -> DataFrame:
    """``key`` with eps, pe (null for losses), earnings_yield and pb; inputs by key: ttm, shares, book, price."""
    b = prices.join(ttm.select("key", "ttm"), "key", "left").join(shares.select("key", "shares"), "key", "left").join(book.select("key", "book"), "key", "left")
    eps = F.col("ttm") * unit / F.col("shares")
    priced = F.col("price") > 0
    return b.select(
        "key",
        eps.alias("eps"),
        F.when(priced & (eps > 0), F.col("price") / eps).alias("pe"),
        F.when(priced, eps / F.col("price")).alias("earnings_yield"),
        F.when(priced & (F.col("book") > 0), F.col("price") * F.col("shares") / (F.col("book") * unit)).alias("pb"),
    )


def vendor_ratio(snapshots: DataFrame, payload: str, name: str) -> DataFrame:
    """The snapshots with (value, reason) structs ``ratio`` and ``to_sector`` of a named ratio in a JSON payload.

    The payload is a list of {name, company, sector}; numbers may be text with signs.
    """
    rows = F.from_json(F.col(payload), "array<struct<name:string,company:string,sector:string>>")
    s = snapshots.withColumn("_rows", rows).withColumn("_one", F.try_element_at(F.filter("_rows", lambda r: r["name"] == name), F.lit(1)))
    # columns of their own, so that a text is parsed once and not wherever a rule looks at it
    s = s.withColumns({"_own": parse_number(F.col("_one.company")), "_peer": parse_number(F.col("_one.sector"))}).withColumn("_over", F.try_divide("_own", "_peer"))
    own, peer = F.col("_own"), F.col("_peer")
    bad, absent = (F.col("_rows").isNull(), MALFORMED_INPUT), (F.col("_one").isNull() | own.isNull(), MISSING_INPUT)
    return s.withColumns({"ratio": result(own, bad, absent), "to_sector": result(F.col("_over"), bad, absent, (peer.isNull(), MISSING_INPUT), (peer <= 0, DIVISION_UNDEFINED))}).drop("_rows", "_one", "_own", "_peer", "_over")


def forensic_flags(ratios: DataFrame) -> DataFrame:
    """Adds the lists ``red`` and ``green`` of the threshold rules that a company's ratios meet."""
    r = lambda c: F.col(c)
    red = [(r("debt_to_equity") > 2, "HIGH_DEBT"), (r("pledged_pct") > 25, "PLEDGED_SHARES"), (r("roe") < 0, "NEGATIVE_ROE"), (r("pe") > 100, "EXTREME_PE"), (r("profit_growth") < -0.25, "PROFIT_FALL")]
    green = [(r("roe") > 0.2, "HIGH_ROE"), (r("debt_to_equity") < 0.1, "LOW_DEBT"), (r("profit_growth") > 0.2, "PROFIT_GROWTH"), (r("pledged_pct") == 0, "NOTHING_PLEDGED")]
    listed = lambda rules: F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))
    return ratios.withColumns({"red": listed(red), "green": listed(green)})
