"""Corporate actions: exact factors, point-in-time adjustment of prices, classification of revisions.  :mod:`basis` has what a vendor had applied already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors keep twelve places through every product.
FACTOR = "decimal(24,12)"


def exact_factor(kind: Column, new: Column, old: Column) -> Column:
    """SPLIT: face value before over after; BONUS: (new + old) / old; anything else has no exact factor."""
    value = F.when(kind == "SPLIT", old.cast(FACTOR) / new.cast(FACTOR)).when(kind == "BONUS", (new + old).cast(FACTOR) / old.cast(FACTOR))
    return value.cast(FACTOR)


def product(factors: Column) -> Column:
    """The exact product of an array of factors (1 for none), cut to twelve places at each step."""
    one = F.lit(1).cast("decimal(38,12)")
    return F.aggregate(F.coalesce(factors, F.array().cast(f"array<{FACTOR}>")), one, lambda a, x: (a * x.cast("decimal(20,12)")).cast("decimal(38,12)"))


def target_factor(bars: DataFrame, actions: DataFrame, instant: Column) -> DataFrame:
    """The bars with ``target``: the product of the factors that came into effect after the bar.

    Only actions count that were knowable before the instant and ex by then.  Actions are
    few per key: they are gathered into one array per key (a listing's whole history is
    some dozen) and joined by key, so no bar is multiplied by them.
    """
    seen = actions.where((F.col("knowable_at") < instant) & (F.col("ex_at") <= instant))
    per_key = seen.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ex_at", "action_id", "factor"))).alias("_a"))
    after = F.transform(F.filter("_a", lambda a: a["ex_at"] > F.col("bucket")), lambda a: a["factor"])
    return bars.join(per_key, "key", "left").withColumn("target", product(after)).drop("_a")


def adjusted(bars: DataFrame, actions: DataFrame, instant: Column) -> DataFrame:
    """Bars on the basis of the instant: prices over the net factor to six places (half to even), volume times it.

    A column ``baked`` names what the vendor had already applied (1, if it is missing).
    Status is AS_STORED for a net factor of 1, ADJUSTED above, RECONSTRUCTED below.
    """
    b = target_factor(bars, actions, instant)
    baked = F.col("baked").cast("decimal(38,12)") if "baked" in bars.columns else F.lit(1).cast("decimal(38,12)")
    net = (F.col("target") / baked).cast("decimal(38,12)")
    b = b.withColumn("net", net)
    price = lambda c: F.bround(F.col(c).cast("decimal(18,6)") / F.col("net").cast("decimal(20,12)"), 6).cast("decimal(18,6)").alias(c)
    status = F.when(F.col("net") == 1, "AS_STORED").when(F.col("net") > 1, "ADJUSTED").otherwise("RECONSTRUCTED")
    rest = [c for c in bars.columns if c not in ("open", "high", "low", "close", "volume", "baked")]
    return b.select(*rest, *[price(c) for c in ("open", "high", "low", "close")], (F.col("volume") * F.col("net")).cast("decimal(38,6)").alias("volume"), "net", status.alias("status"))


def classify_revision(stored: Column, new: Column, factors: Column, tick: float = 0.05, same_session: Column | None = None) -> Column:
    """Why a bar's price was re-observed differently.

    CA_ADJUSTMENT when some product of a subset of the factors (an array of a few)
    explains it, ROUNDING within a tick, SETTLEMENT on the bar's own session, else UNEXPLAINED.
    """
    one = F.array(F.lit(1.0))
    subsets = F.aggregate(F.coalesce(factors, F.array().cast("array<double>")), one, lambda out, x: F.concat(out, F.transform(out, lambda p: p * x)))
    explained = F.exists(F.filter(subsets, lambda p: F.abs(p - 1) > 1e-12), lambda p: F.abs(stored / p - new) <= tick)
    late = F.lit(False) if same_session is None else same_session
    return F.when(stored == new, "SAME").when(F.abs(stored - new) <= tick, "ROUNDING").when(explained, "CA_ADJUSTMENT").when(late, "SETTLEMENT").otherwise("UNEXPLAINED")
