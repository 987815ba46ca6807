"""Domain relations over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import rollup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of each event type, with the time they became knowable: some seconds to hours after their end."""
    b = rollup(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id", unit)
    return b.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def bars_sql(unit: str = "hour", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT event_type AS key, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS bucket, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)"""


def known_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with ``knowable_at``: the end of the bar plus 0, 1, 2 or 3 hours by its volume."""
    return bars(spark, sf_dir).withColumn("knowable_at", F.expr("bucket + make_dt_interval(0, CAST(1 + volume % 4 AS INT), 0, 0)"))


KNOWN_SQL = bars_sql() + """, known AS (SELECT *, bucket + to_hours(CAST(1 + volume % 4 AS INTEGER)) AS knowable_at FROM bars)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions by rule from ``nation``: a factor per key and ex-date, knowable a day before or a day after."""
    return table(spark, sf_dir, "nation").selectExpr(
        "element_at(array('view','error','purchase','click','signup'), CAST(n_nationkey % 5 AS INT) + 1) AS key",
        "n_nationkey AS action_id",
        "timestampadd(HOUR, CAST((n_nationkey * 37) % 700 AS INT), timestamp_ntz'2024-01-01') AS ex_at",
        "timestampadd(HOUR, CAST((n_nationkey * 37) % 700 + CASE WHEN n_nationkey % 3 = 0 THEN 24 ELSE -24 END AS INT), timestamp_ntz'2024-01-01') AS knowable_at",
        "CAST(1 + (n_nationkey % 4) AS DECIMAL(24,12)) / CAST(2 AS DECIMAL(24,12)) AS raw_factor",
    ).withColumn("factor", F.col("raw_factor").cast("decimal(24,12)")).drop("raw_factor")


ACTIONS_SQL = """actions AS (
  SELECT list_extract(['view','error','purchase','click','signup'], CAST(n_nationkey % 5 AS INTEGER) + 1) AS key, n_nationkey AS action_id,
         TIMESTAMP '2024-01-01' + to_hours(CAST((n_nationkey * 37) % 700 AS INTEGER)) AS ex_at,
         TIMESTAMP '2024-01-01' + to_hours(CAST((n_nationkey * 37) % 700 + CASE WHEN n_nationkey % 3 = 0 THEN 24 ELSE -24 END AS INTEGER)) AS knowable_at,
         (1 + (n_nationkey % 4)) / 2.0 AS factor
  FROM nation)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by month: turnover, mean discount and lines, as a cross-section per session."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("session"), F.col("l_suppkey").alias("key"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("turnover"), F.round(F.avg("l_discount"), 6).alias("score"), F.round(F.avg("l_tax"), 6).alias("spread"), F.count("*").alias("lines"))
    )


MONTHLY_SQL = """monthly AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS session, l_suppkey AS key, round(sum(l_extendedprice), 2) AS turnover, round(avg(l_discount), 6) AS score,
         round(avg(l_tax), 6) AS spread, count(*) AS lines FROM lineitem GROUP BY 1, 2)"""


def desk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each supplier's unit prices by the shipping week, knowable 8, 9 or 10 days after its Monday; rows grow with ``lineitem``."""
    l = table(spark, sf_dir, "lineitem").withColumns({"key": F.col("l_suppkey"), "bucket": F.date_trunc("week", "l_shipdate").cast("timestamp_ntz"), "price": F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100})  # noqa: E741
    return _week(l)


def desk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars over all suppliers, as key 0."""
    l = table(spark, sf_dir, "lineitem").withColumns({"key": F.lit(0).cast("long"), "bucket": F.date_trunc("week", "l_shipdate").cast("timestamp_ntz"), "price": F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100})  # noqa: E741
    return _week(l)


def _week(lines: DataFrame) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    bars = lines.groupBy("key", "bucket").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").cast("long").alias("volume"), (F.sum("l_linenumber") % 3).cast("int").alias("_late")
    )
    return bars.withColumn("knowable_at", F.col("bucket") + F.make_dt_interval(days=8 + F.col("_late"))).drop("_late")


DESK_SQL = """lines AS (SELECT l_suppkey AS key, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS bucket, floor(l_extendedprice / l_quantity * 100) / 100 AS price, * FROM lineitem),
desk AS (SELECT key, bucket, arg_min(price, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (l_shipdate, l_orderkey, l_linenumber)) AS close,
  CAST(sum(l_quantity) AS BIGINT) AS volume, bucket + to_days(CAST(8 + sum(l_linenumber) % 3 AS INTEGER)) AS knowable_at FROM lines GROUP BY 1, 2)"""
INDEX_SQL = """desk_index AS (SELECT 0 AS key, bucket, arg_max(price, (l_shipdate, l_orderkey, l_linenumber)) AS close, bucket + to_days(CAST(8 + sum(l_linenumber) % 3 AS INTEGER)) AS knowable_at FROM lines GROUP BY 2)"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants: the starts of all months that ``lineitem`` ships in but the first, each with its last weekly session."""
    m = table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("as_of")).distinct().where("as_of > timestamp_ntz'1995-01-01'")
    return m.withColumn("previous_session", F.date_trunc("week", F.col("as_of") - F.expr("INTERVAL '8' DAY") - F.expr("INTERVAL '1' SECOND")).cast("timestamp_ntz"))


MONTHS_SQL = """months AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS as_of FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-02-01'),
instants AS (SELECT as_of, CAST(date_trunc('week', as_of - INTERVAL 8 DAY - INTERVAL 1 SECOND) AS TIMESTAMP) AS previous_session FROM months)"""


def text_of(column: str) -> str:
    """A timestamp as text, the same on both sides."""
    return f"CAST({column} AS STRING)"
