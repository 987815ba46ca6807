"""The basis of stored prices: which corporate actions a vendor's value contains already, and prices as known at an instant.

Factors are ratios of whole numbers.  The actions of a key, in the order of their ex-dates,
carry running products, so the product over any stretch of time is a quotient of two of
them: one at the stretch's end, one at the bar, each found by an as-of lookup.  Numerators
and denominators are kept apart, so every quotient is exact; no bar meets a list of actions.
"""

from __future__ import annotations

from decimal import Decimal
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alike import stored
from .pit import asof_join

WHOLE = "decimal(38,0)"
RAW_OBSERVED, VENDOR_ADJUSTED = "RAW_OBSERVED", "VENDOR_ADJUSTED"
#: |ln F| below this cannot be told from a market move; a jump may be this far off in logarithms.
DISTINGUISHABLE, TOLERANCE = 0.2, 0.15
LOW, RECONSTRUCTED = "low_confidence", "reconstructed"
#: Twice this is a long still.
_LONG = 4_000_000_000_000_000_000


# -- factors --------------------------------------------------------------------------------


def factor_of(kind: Column, ratio_new: Column, ratio_old: Column, face_before: Column, face_after: Column) -> Column:
    """``(status, num, den, reason)`` of an action: EXACT with a factor num / den, else UNCERTAIN or UNSUPPORTED with neither.

    A split's factor is the old face value over the new one, if a ratio that is given agrees
    with both; a bonus of a for b is (a + b) / b.  Rights need an issue price that only free text
    has, dividends are no price factors.  All four inputs are whole numbers or null.
    """
    def exact(num: Column, den: Column) -> Column:
        return F.struct(F.lit("EXACT").alias("status"), num.cast("long").alias("num"), den.cast("long").alias("den"), F.lit(None).cast("string").alias("reason"))

    def none(status: str, reason: str | Column) -> Column:
        why = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(status).alias("status"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("long").alias("den"), why.alias("reason"))

    ratio = F.coalesce((ratio_new > 0) & (ratio_old > 0), F.lit(False))
    faces = F.coalesce((face_before > 0) & (face_after > 0), F.lit(False))
    split = F.when(~faces, none("UNCERTAIN", "face values missing")).when(ratio & ((ratio_new != face_after) | (ratio_old != face_before)), none("UNCERTAIN", "the ratio disagrees with the face values")).otherwise(exact(face_before, face_after))
    bonus = F.when(ratio, exact(ratio_new + ratio_old, ratio_old)).otherwise(none("UNCERTAIN", "no usable ratio"))
    return F.when(kind == "SPLIT", split).when(kind == "BONUS", bonus).when(kind == "RIGHTS", none("UNSUPPORTED", "the issue price is not provable")).when(kind == "DIVIDEND", none("UNSUPPORTED", "dividends are no price factors")).otherwise(none("UNSUPPORTED", F.concat(F.coalesce(kind, F.lit("null")), F.lit(": no factor rule"))))


def _micro(value: Column) -> Column:
    return F.abs(value.cast("decimal(20,6)") * 1_000_000).cast("decimal(20,0)")


def _rounded(top: Column, bottom: Column, even: bool = True) -> Column:
    """The whole number next to top / bottom (whole, not negative): halves to the even one, or up."""
    top, bottom = top.cast(WHOLE), bottom.cast("decimal(18,0)")
    rest = top % bottom
    low = ((top - rest) / bottom).cast(WHOLE)
    half = rest * 2 == bottom
    return (low + F.when((rest * 2 > bottom) | (half & ((low % 2 == 1) if even else F.lit(True))), 1).otherwise(0)).cast("decimal(31,0)")


def over_ratio(value: Column, num: Column, den: Column) -> Column:
    """value / (num / den) to six places, halves to even, from whole numbers throughout."""
    return (F.when(value < 0, -1).otherwise(1) * _rounded(_micro(value) * den.cast("decimal(18,0)"), num) / 1_000_000).cast("decimal(24,6)")


def _over_long(value: str, num: str, den: str) -> Column:
    """:func:`over_ratio` of columns whose millionths ``_m_<value>`` and ``_<num>, _<den>`` are there as long: in those where they suffice.

    A column of a row is made once; inside one expression every use of a decimal is worked out anew.
    """
    m, n, d = f"`_m_{value}`", f"`_{num}`", f"`_{den}`"
    low, twice = f"({m} * {d} DIV {n})", f"({m} * {d} % {n} * 2)"
    fits = F.expr(f"{n} BETWEEN 1 AND {_LONG} AND {d} > 0 AND {m} <= {_LONG} DIV {d}")
    whole = F.expr(f"{low} + CASE WHEN {twice} > {n} OR ({twice} = {n} AND {low} % 2 = 1) THEN 1L ELSE 0L END")
    fast = (F.when(F.col(value) < 0, -whole).otherwise(whole).cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(24,6)")
    return F.when(fits, fast).otherwise(over_ratio(F.col(value), F.col(num), F.col(den)))


def multiplier(num: Column, den: Column) -> Column:
    """The factor's reciprocal in ten-thousandths, halves up."""
    return _rounded(den.cast("decimal(18,0)") * 10_000, num, even=False)


def to_tick(raw: Column, num: Column, den: Column, tick: Column) -> Column:
    """A price over its factor, half to even to the tick: how vendors round an adjusted price."""
    step = _micro(tick).cast("decimal(12,0)")
    return (_rounded(_micro(raw) * den.cast("decimal(12,0)"), num.cast("decimal(6,0)") * step).cast("decimal(18,0)") * step / 1_000_000).cast("decimal(24,6)")


def to_tick_by_multiplier(raw: Column, num: Column, den: Column, tick: Column) -> Column:
    """The other convention: the price times the four-place multiplier, half to even to the tick."""
    step = _micro(tick).cast("decimal(12,0)")
    return (_rounded(_micro(raw) * multiplier(num, den).cast("decimal(12,0)"), step * 10_000).cast("decimal(18,0)") * step / 1_000_000).cast("decimal(24,6)")


def volume_by_multiplier(raw: Column, num: Column, den: Column) -> Column:
    """A volume over the multiplier, halves up to a whole share."""
    return _rounded(raw.cast("decimal(18,0)") * 10_000, multiplier(num, den).cast("decimal(18,0)"), even=False)


def convention(stored: DataFrame, prices: tuple[str, ...], tick: float, seen: str = "new_") -> Column:
    """Which convention explains a whole bar: all its prices and its volume (columns ``num, den`` and both observations).

    ``exact`` is tried first; null if neither does.
    """
    n, d, t = F.col("num").cast("decimal(18,0)"), F.col("den").cast("decimal(18,0)"), F.lit(tick)
    same = lambda made, name: made.cast("decimal(18,4)") == F.col(f"{seen}{name}").cast("decimal(18,4)")
    first = [same(to_tick(F.col(c), n, d, t), c) for c in prices] + [F.col("volume").cast("decimal(22,0)") * n == F.col(f"{seen}volume").cast("decimal(22,0)") * d]
    second = [same(to_tick_by_multiplier(F.col(c), n, d, t), c) for c in prices] + [volume_by_multiplier(F.col("volume"), n, d) == F.col(f"{seen}volume").cast("decimal(22,0)")]
    every = lambda tests: F.forall(F.array(*tests), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(every(first), "exact").when(every(second), "reciprocal-4dp")


def same_observation(a: str, b: str, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume", "open_interest")) -> Column:
    """Whether two observations (columns under the prefixes ``a`` and ``b``) have equal values; null equals null only."""
    same = F.lit(True)
    for f in fields:
        same &= F.col(f"{a}{f}").cast("decimal(28,6)").eqNullSafe(F.col(f"{b}{f}").cast("decimal(28,6)"))
    return same


# -- what a payload contains ----------------------------------------------------------------


def price_basis(bars: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``payload, price_basis, basis_as_of`` of each payload that has none yet.

    Values of the running session (``endpoint`` intraday) and of global segments are as
    observed; all others the vendor had adjusted up to the day it was asked.  A payload was
    fetched once: of rows that disagree the earliest decides.
    """
    raw = F.col("segment").startswith("GLOBAL") | (F.col("endpoint") == "intraday")
    first = F.min(F.struct("fetched_at", "endpoint", "segment"))
    found = bars.groupBy("payload").agg(first.alias("f")).select("payload", F.col("f.*"))
    found = found.select("payload", F.when(raw, RAW_OBSERVED).otherwise(VENDOR_ADJUSTED).alias("price_basis"), F.to_date("fetched_at").alias("basis_as_of"))
    return found if known is None else found.join(known.select("payload"), "payload", "left_anti")


def around(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with structs ``before`` and ``after``: the right rows of its key next to it, strictly before and from its time on.

    Both sides are laid out in one order: one shuffle and one sort.  Of right rows of one
    time the greatest values count before, the least after.
    """
    kind = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    a = left.select(key, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_v"))
    b = right.select(key, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(key).orderBy("_at", "_side", "_v")
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return a.unionByName(b).select("*", before.alias("before"), after.alias("after")).where("_side = 0").select("_row.*", "before", "after")


def treatment(num: Column, den: Column, previous_close: Column, ex_open: Column, previous_basis: Column, ex_date: Column, observations: Column) -> Column:
    """``(state, why)``: whether the vendor's history contains a factor.

    APPLIED if later observations were explained by exactly it, or the series runs smoothly
    over the ex-date; NOT_APPLIED if it jumps by the factor; UNKNOWN if the earlier bar was
    fetched before the ex-date, one side is missing, the factor is near 1 or the jump is
    neither; N/A without a factor.
    """
    said = lambda state, why: F.struct(F.lit(state).alias("state"), F.lit(why).alias("why"))
    size = F.log(num / den)
    jump = F.log(previous_close / ex_open)
    near = lambda x: F.abs(x) < TOLERANCE
    return (
        F.when(num.isNull(), said("N/A", "no factor"))
        .when(observations > 0, said("APPLIED", "later observations are explained by it"))
        .when(previous_close.isNotNull() & (previous_basis < ex_date), said("UNKNOWN", "the bars before were fetched before the ex-date"))
        .when(previous_close.isNull() | ex_open.isNull(), said("UNKNOWN", "no bar on one side of the ex-date"))
        .when(F.abs(size) < DISTINGUISHABLE, said("UNKNOWN", "the factor is too near 1"))
        .when(near(jump - size), said("NOT_APPLIED", "the series jumps by the factor"))
        .when(near(jump), said("APPLIED", "the series is smooth over the ex-date"))
        .otherwise(said("UNKNOWN", "the jump is neither the factor's nor none"))
    )


def derive_factors(actions: DataFrame, bars: DataFrame, basis: DataFrame, explained: DataFrame) -> DataFrame:
    """The actions with ``status, num, den, reason`` and ``treatment, why``.

    ``actions``: action_id, key, kind, ex_date, ratio_new, ratio_old, face_before, face_after and
    more; ``bars``: key, day, open, close, payload; ``basis`` as from :func:`price_basis`;
    ``explained``: action_id, one row for every observation that the action explained.
    """
    made = actions.withColumn("_f", factor_of(F.col("kind"), F.col("ratio_new"), F.col("ratio_old"), F.col("face_before"), F.col("face_after")))
    near = around(made, bars.join(basis.select("payload", "basis_as_of"), "payload", "left").select("key", "day", "open", "close", "basis_as_of"), "key", "ex_date", "day", ["day", "open", "close", "basis_as_of"])
    counted = near.join(explained.groupBy("action_id").agg(F.count("*").alias("_n")), "action_id", "left")
    told = treatment(F.col("_f.num"), F.col("_f.den"), F.col("before.close"), F.col("after.open"), F.col("before.basis_as_of"), F.col("ex_date"), F.coalesce("_n", F.lit(0)))
    return counted.withColumn("_t", told).select(*actions.columns, F.col("_f.status").alias("status"), F.col("_f.num").alias("num"), F.col("_f.den").alias("den"), F.col("_f.reason").alias("reason"), F.col("_t.state").alias("treatment"), F.col("_t.why").alias("why"))


# -- prices as known at an instant ----------------------------------------------------------


def running_products(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The rows with ``columns`` replaced by their products over all rows of the same keys up to and with each, exactly.

    Products double their reach step by step, all steps in one partitioning and order, so
    nothing is gathered and nothing is shuffled again.  A product of more than 38 digits is an error.
    """
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns({c: F.col(c).cast(WHOLE) for c in columns})
    for step in range(ceil(log2(most)) if most > 1 else 0):
        rows = rows.withColumns({c: (F.col(c) * F.coalesce(F.lag(c, 1 << step).over(w), F.lit(1).cast(WHOLE))).cast(WHOLE) for c in columns})
    return rows


def _whole(a: Column, b: Column) -> Column:
    """The quotient of two running products: a whole number."""
    return (a / b).cast(WHOLE)


def bars_as_known(bars: DataFrame, factors: DataFrame, basis: DataFrame, excluded: DataFrame, instant: Column, allow_reconstructed: bool = False, allow_low_confidence: bool = False) -> DataFrame:
    """The bars knowable before the instant, on the basis a trader knew at it.

    ``bars``: key, day, open, high, low, close, volume, payload, knowable_at; ``factors`` as from
    :func:`derive_factors`, with knowable_at; ``excluded``: (payload, action_id) of payloads
    of which the vendor later served a bar again that this action explains, so the payload
    does not contain it.

    ``target`` is the product of the exact factors with day < ex_date <= the instant's day that
    were knowable before it; ``baked`` that of the factors the vendor had applied with day <
    ex_date <= the payload's basis_as_of, less the excluded ones.  The net factor num / den =
    target / baked is exact: AS_STORED at 1, ADJUSTED above, RECONSTRUCTED below.
    Confidence is LOW without a basis, and for adjusted payloads when an action of unknown
    treatment lies in between, before the earliest ex-date known at the instant, or when none is known.

    Columns: those of ``bars`` with prices over and volume times the factor (six places), and
    ``num, den, status, confidence, price_basis, basis_as_of, actions_known, refusal``: a row that
    may not be used says why (reconstructed or low confidence, unless allowed) and keeps its
    stored values, so :func:`refused` can count what :func:`usable` leaves out.
    """
    today = F.to_date(instant)
    exact = factors.where((F.col("status") == "EXACT") & F.col("ex_date").isNotNull())
    known = (F.col("knowable_at") < instant) & (F.col("ex_date") <= today)
    applied = F.col("treatment") == "APPLIED"
    one = F.lit(1).cast("long")
    events = exact.select(
        "key", "ex_date", "action_id",
        *[F.when(flag, F.col(c)).otherwise(one).alias(f"{side}_{c}") for side, flag in (("t", known), ("b", applied)) for c in ("num", "den")],
        known.cast("int").alias("known"), (F.col("treatment") == "UNKNOWN").cast("int").alias("unknown"),
    )
    products = ["t_num", "t_den", "b_num", "b_den"]
    along = Window.partitionBy("key").orderBy("ex_date", "action_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = stored(running_products(events, ["key"], ["ex_date", "action_id"], products).withColumns({c: F.sum(c).over(along) for c in ("known", "unknown")}), "known-events")

    seen = bars.where(F.col("knowable_at") < instant).join(basis, "payload", "left")
    # actions of the bar's own day do not count for it any more: they are looked up with it
    next_day = lambda c: F.date_add(F.col(c), 1)
    values = [*products, "known", "unknown"]
    at_bar = asof_join(seen.withColumn("_at_day", next_day("day")), events, ["key"], "_at_day", "ex_date", ["ex_date", "action_id"], values)
    ends = events.groupBy("key").agg(*[F.max_by(c, F.struct("ex_date", "action_id")).alias(f"end_{c}") for c in ("t_num", "t_den", "known")])
    asked = seen.where("basis_as_of IS NOT NULL").select("key", "basis_as_of").distinct().withColumn("_basis_day", next_day("basis_as_of"))
    at_basis = asof_join(asked, events, ["key"], "_basis_day", "ex_date", ["ex_date", "action_id"], ["b_num", "b_den", "unknown"])
    at_basis = at_basis.select("key", "basis_as_of", *[F.col(c).alias(f"basis_{c}") for c in ("b_num", "b_den", "unknown")])

    # excluded actions, by payload: what of them lies between a bar and its payload's basis
    own = excluded.distinct().join(exact.where(applied).select("action_id", "ex_date", "num", "den"), "action_id").join(basis.select("payload", "basis_as_of"), "payload").where("ex_date <= basis_as_of")
    own = running_products(own.select("payload", "ex_date", "action_id", F.col("num").alias("x_num"), F.col("den").alias("x_den")), ["payload"], ["ex_date", "action_id"], ["x_num", "x_den"])
    own = stored(own, "excluded-products")
    whole = own.groupBy("payload").agg(*[F.max_by(c, F.struct("ex_date", "action_id")).alias(f"end_{c}") for c in ("x_num", "x_den")])
    b = asof_join(at_bar, own, ["payload"], "_at_day", "ex_date", ["ex_date", "action_id"], ["x_num", "x_den"])
    b = b.join(ends, "key", "left").join(at_basis, ["key", "basis_as_of"], "left").join(whole, "payload", "left")

    v = lambda c: F.coalesce(F.col(c), F.lit(1).cast(WHOLE))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    t_num, t_den = _whole(v("end_t_num"), v("t_num")), _whole(v("end_t_den"), v("t_den"))
    # a bar may lie behind its payload's basis: then nothing is baked into it
    inside = (F.col("price_basis") == VENDOR_ADJUSTED) & (F.col("day") < F.col("basis_as_of"))
    baked = lambda c: F.when(inside, _whole(_whole(v(f"basis_b_{c}"), v(f"b_{c}")), _whole(v(f"end_x_{c}"), v(f"x_{c}")))).otherwise(F.lit(1).cast(WHOLE))
    b = b.withColumns({"_tn": t_num, "_td": t_den, "_bn": baked("num"), "_bd": baked("den")})
    b = b.withColumns({"num": (F.col("_tn") * F.col("_bd")).cast(WHOLE), "den": (F.col("_td") * F.col("_bn")).cast(WHOLE)})
    horizon = factors.where((F.col("knowable_at") < instant) & F.col("ex_date").isNotNull()).agg(F.min("ex_date").alias("_horizon"))
    b = b.join(F.broadcast(horizon), F.lit(True))  # one row
    between = F.when(inside, n("basis_unknown") - n("unknown")).otherwise(0) > 0
    low = F.col("price_basis").isNull() | ((F.col("price_basis") == VENDOR_ADJUSTED) & (between | F.col("_horizon").isNull() | (F.col("day") < F.col("_horizon"))))
    status = F.when(F.col("num") == F.col("den"), "AS_STORED").when(F.col("num") > F.col("den"), "ADJUSTED").otherwise("RECONSTRUCTED")
    b = b.withColumns({"status": status, "confidence": F.when(low, "LOW").otherwise("HIGH")})
    refusal = F.when((F.col("confidence") == "LOW") & F.lit(not allow_low_confidence), LOW).when((F.col("status") == "RECONSTRUCTED") & F.lit(not allow_reconstructed), RECONSTRUCTED)
    b = b.withColumn("refusal", refusal)
    prices, usable_row = ("open", "high", "low", "close"), F.col("refusal").isNull()
    b = b.withColumns({"_num": F.col("num").try_cast("long"), "_den": F.col("den").try_cast("long"), **{f"_m_{c}": F.when(usable_row, _micro(F.col(c)).try_cast("long")) for c in (*prices, "volume")}})
    made = {c: F.when(usable_row, _over_long(c, "num", "den")).otherwise(F.col(c).cast("decimal(24,6)")) for c in prices}
    made["volume"] = F.when(usable_row, _over_long("volume", "den", "num")).otherwise(F.col("volume").cast("decimal(24,6)"))
    return b.withColumn("actions_known", n("end_known") - n("known")).select(*[made[c].alias(c) if c in made else F.col(c) for c in bars.columns], "num", "den", "status", "confidence", "price_basis", "basis_as_of", "actions_known", "refusal")


def usable(bars: DataFrame) -> DataFrame:
    return bars.where("refusal IS NULL").drop("refusal")


def refused(bars: DataFrame) -> DataFrame:
    """``key, reconstructed, low_confidence``: how many bars of each key were refused, and why; zeros for a key that lost none."""
    return bars.groupBy("key").agg(*[F.count_if(F.col("refusal") == why).alias(why) for why in (RECONSTRUCTED, LOW)])
