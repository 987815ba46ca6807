"""Quality gates: each is a query for violations; a gate passes when it has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(gates: dict[str, DataFrame]) -> DataFrame:
    """``gate, violations, status``: one row per gate, also for those without a violation."""
    counted = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations") for name, df in gates.items()]
    return reduce(DataFrame.unionByName, counted).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def overlapping(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Validity ranges that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.where(F.col(start) <= F.col(end)).withColumn("_until", F.max(end).over(w)).where(F.col(start) < F.col("_until")).drop("_until")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def without_parent(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    return df.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def bar_faults() -> Column:
    """The names of all rules that a bar breaks."""
    rules = [
        (F.least("open", "high", "low", "close") <= 0, "NOT_POSITIVE"),
        (F.col("high") < F.greatest("open", "close", "low"), "HIGH_TOO_LOW"),
        (F.col("low") > F.least("open", "close", "high"), "LOW_TOO_HIGH"),
        (F.col("volume") < 0, "NEGATIVE_VOLUME"),
        (F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull(), "MISSING_PRICE"),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))


def archive_scan(bars: DataFrame, by: list[str]) -> DataFrame:
    """Violation counters and bar counts per group in one pass; partial scans add up (:func:`add_scans`)."""
    f = bars.withColumn("_f", bar_faults())
    has = lambda n: F.count_if(F.array_contains("_f", n)).alias(n.lower())
    return f.groupBy(*by).agg(F.count("*").alias("bars"), *[has(n) for n in ("NOT_POSITIVE", "HIGH_TOO_LOW", "LOW_TOO_HIGH", "NEGATIVE_VOLUME", "MISSING_PRICE")])


def add_scans(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """A stored scan and a later one as one."""
    counters = [c for c in a.columns if c not in by]
    return a.unionByName(b).groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters])


def look_ahead(features: DataFrame) -> DataFrame:
    """Rows whose inputs were not all knowable strictly before their instant."""
    return features.where(~(F.col("input_max_knowable_at") < F.col("as_of")))


def value_or_reason(features: DataFrame) -> DataFrame:
    """Rows that have both a value and a reason, or neither, or a value that is not finite."""
    return features.where((F.col("value").isNotNull() == F.col("reason").isNotNull()) | F.isnan("value") | (F.abs("value") == float("inf")))
