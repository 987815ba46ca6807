"""Training samples: what a key is good for at an instant, and whether labels and samples agree with their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import violations

MASKED_FLAGS = ("EXTREME_UNEXPLAINED", "AMBIGUOUS_ORDER_1", "AMBIGUOUS_ORDER_2")


def samples(core: DataFrame, labels: DataFrame, near_action: DataFrame, total: int) -> DataFrame:
    """One row per (session, key) with why it may or may not be used.

    ``core``: session, key, feature_id, status, one row per core feature that was computed; ``labels``: session, key, label_id,
    status, reason, flags; ``near_action``: session, key of those near a corporate action.  Core features without a
    row count as not valid.  A sample is eligible when nothing excludes it.
    """
    c = core.groupBy("session", "key").agg(F.array_sort(F.collect_set(F.when(F.col("status") != "VALID", F.col("feature_id")))).alias("core_not_valid"), F.count_if(F.col("status") == "VALID").alias("core_valid"))
    lab = labels.groupBy("session", "key").agg(
        F.array_sort(F.collect_set(F.when(F.col("status") == "VALID", F.col("label_id")))).alias("labels_valid"), F.count("*").alias("_l"), F.count_distinct(F.coalesce("reason", F.lit(""))).alias("_r"), F.min("reason").alias("_why"), F.count("reason").alias("_w"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("label_flags"),
    )
    s = c.join(lab, ["session", "key"], "left").join(near_action.select("session", "key", F.lit(True).alias("_ca")).distinct(), ["session", "key"], "left")
    none = F.array().cast("array<string>")
    s = s.withColumns({"labels_valid": F.coalesce("labels_valid", none), "label_flags": F.coalesce("label_flags", none)})
    label_fault = F.when(F.col("_l").isNull(), "NO_LABEL").when((F.size("labels_valid") == 0) & (F.col("_r") == 1) & (F.col("_w") == F.col("_l")), F.concat(F.lit("LABEL_"), "_why")).when(F.size("labels_valid") == 0, "LABEL_NONE_VALID")
    feature_fault = F.when(F.col("core_valid") < total, "CORE_FEATURE_NOT_VALID")
    masks = F.array_sort(F.array_compact(F.concat(F.filter("label_flags", lambda f: f.isin(*MASKED_FLAGS)), F.array(F.when(F.col("_ca"), "CA_WINDOW")))))
    why = F.array_sort(F.array_compact(F.array(label_fault, feature_fault)))
    return s.select("session", "key", "core_valid", "core_not_valid", "labels_valid", "label_flags", masks.alias("masks"), why.alias("exclusions"), (F.size(why) == 0).alias("eligible"))


def label_integrity(labels: DataFrame) -> DataFrame:
    """Gates over labels: a value or a reason but not both, flags that agree within a key, one row per label, VALID only with a value."""
    both = labels.where(F.col("value").isNull() == F.col("reason").isNull())
    flags = labels.groupBy("session", "key").agg(F.count_distinct(F.array_sort("flags")).alias("n")).where("n > 1")
    twice = labels.groupBy("session", "key", "label_id").agg(F.count("*").alias("n")).where("n > 1")
    status = labels.where((F.col("status") == "VALID") != F.col("value").isNotNull())
    infinite = labels.where(F.isnan("value") | (F.abs("value") == float("inf")))
    return violations({"value_or_reason": both, "flags_differ": flags, "label_twice": twice, "status_without_value": status, "not_finite": infinite})


def sample_integrity(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Gates over samples: eligible only without exclusions, valid labels that exist, one row per key and session."""
    exclusion = samples.where(F.col("eligible") != (F.size("exclusions") == 0))
    used = samples.select("session", "key", F.explode("labels_valid").alias("label_id"))
    absent = used.join(labels.where("status = 'VALID'").select("session", "key", "label_id"), ["session", "key", "label_id"], "left_anti")
    twice = samples.groupBy("session", "key").agg(F.count("*").alias("n")).where("n > 1")
    return violations({"eligible_with_exclusion": exclusion, "label_absent": absent, "sample_twice": twice})


def ready_outcomes(predicted: DataFrame, bars: DataFrame, least: float = 0.9) -> DataFrame:
    """``session, predicted, priced, ready``: whether enough of a session's predicted names have a bar."""
    seen = predicted.join(bars.select("session", "key", F.lit(1).alias("_b")).distinct(), ["session", "key"], "left")
    return seen.groupBy("session").agg(F.count("*").alias("predicted"), F.count("_b").alias("priced")).withColumn("ready", F.col("priced") >= F.col("predicted") * least)


def keys_on_all(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """The keys that have a bar on every one of the sessions."""
    n = sessions.select("session").distinct()
    need = n.agg(F.count("*").alias("_need"))
    got = bars.join(F.broadcast(n), "session").groupBy("key").agg(F.count_distinct("session").alias("_n"))
    return got.join(F.broadcast(need), F.col("_n") == F.col("_need")).select("key")


def skip_counts(skips: DataFrame, reviews: DataFrame, trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skips per strategy and reason, and each trade with its latest review (reviews: trade_id, at, review_id, verdict)."""
    counted = skips.groupBy("strategy", "reason").agg(F.count("*").alias("skips"))
    last = reviews.groupBy("trade_id").agg(F.max_by("verdict", F.struct("at", "review_id")).alias("verdict"))
    return counted, trades.join(last, "trade_id", "left")
