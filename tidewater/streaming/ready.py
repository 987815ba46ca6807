"""Readiness of a sharded capture: the marker is set once every shard has passed the instant.

Each shard is a stream with a watermark of its own, its latest time less a margin, and what
counts is the least of them, so a shard that lags holds the marker back, whatever the
others bring.  A query that starts again knows only the least watermark it had, not the
shards' own; so each batch also leaves its shards' latest times beside it, a few rows, and
the marker is decided on those.  It names the first batch that begins with the least
watermark at or behind the instant: all that belongs before it was read in earlier batches,
and what still comes is late.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "shard int, next_seq long, batch long, watermark timestamp, ready_at timestamp"


def shard_streams(spark: SparkSession, folders: dict[int, str], schema: str, at: str = "ts", margin: str = "2 seconds", files_per_batch: int = 1) -> DataFrame:
    """The shards' folders as one stream with a column ``shard``; ``margin`` is how far rows of one shard may be out of order."""
    if spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy", "min") != "min":
        raise ValueError("the watermark has to be the least of the shards'")
    parts = [spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("shard", F.lit(i)).withWatermark(at, margin) for i, path in sorted(folders.items())]
    return reduce(DataFrame.unionByName, parts)


def run_shards(stream: DataFrame, path: str, checkpoint: str, ready_at: datetime, shards: list[int], at: str = "ts", margin_seconds: float = 2.0):
    """Append each batch under ``path/batch=N`` until nothing is left; set the marker once all ``shards`` have passed ``ready_at`` (aware, or UTC) by the margin.

    A batch that is run again overwrites its own folders.  A run goes on behind the
    checkpoint; the marker is set once and stays.
    """
    spark = stream.sparkSession
    ready_at = ready_at if ready_at.tzinfo else ready_at.replace(tzinfo=UTC)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        written = spark.read.parquet(f"{path}/batch={batch_id}")
        written.groupBy("shard").agg(F.max(at).alias("latest"), (F.max("seq") + 1).alias("next_seq")).coalesce(1).write.mode("overwrite").parquet(f"{path}-latest/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if marker(spark, path) is None:
        latest = spark.read.schema("shard int, latest timestamp, next_seq long, batch long").parquet(f"{path}-latest").withColumn("water", F.col("latest") - F.make_dt_interval(secs=F.lit(margin_seconds)))
        wanted = spark.createDataFrame([(s,) for s in shards], "shard int")
        begins = first_ready(latest, wanted, F.lit(ready_at.isoformat()).cast("timestamp"), "water").first()
        if begins:
            upto = latest.where(F.col("batch") < begins["batch"]).groupBy("shard").agg(F.max("next_seq").alias("next_seq"))
            set_at = upto.select("shard", "next_seq", F.lit(begins["batch"]).cast("long").alias("batch"), F.lit(begins["watermark"]).cast("timestamp").alias("watermark"), F.lit(ready_at.isoformat()).cast("timestamp").alias("ready_at"))
            set_at.coalesce(1).write.mode("overwrite").parquet(f"{path}-ready")
    return query


def marker(spark: SparkSession, path: str) -> DataFrame | None:
    """The marker's rows, one a shard, or None while it is not set."""
    try:
        return spark.read.schema(MARKER).parquet(f"{path}-ready")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def problems(spark: SparkSession, path: str, shards: list[int], as_of: datetime, margin_seconds: float = 0.0) -> DataFrame:
    """``shard, problem`` of what speaks against reading as of an instant; no rows: all evidence holds.

    NO_MARKER; EARLY_MARKER (it was set for less than as_of and the margin); MISSING_SHARD;
    GAP (the stored rows of the batches before the marker do not have every seq from 0 up to
    its next_seq, each once).
    """
    schema = "shard int, problem string"
    found = marker(spark, path)
    if found is None:
        return spark.createDataFrame([(None, "NO_MARKER")], schema)
    wanted = spark.createDataFrame([(s,) for s in shards], "shard int")
    as_of = as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC)
    due = F.lit(as_of.isoformat()).cast("timestamp") + F.make_dt_interval(secs=F.lit(margin_seconds))
    stored = spark.read.parquet(path).join(F.broadcast(found.select("shard", F.col("batch").alias("_until"), "next_seq")), "shard").where(F.col("batch") < F.col("_until"))
    held = stored.groupBy("shard").agg(F.count("*").alias("_n"), F.count_distinct("seq").alias("_d"), F.min("seq").alias("_min"), F.max("seq").alias("_max"))
    both = wanted.join(found, "shard", "left").join(held, "shard", "left")
    whole = (F.col("_n") == F.col("next_seq")) & (F.col("_d") == F.col("next_seq")) & (F.col("_min") == 0) & (F.col("_max") + 1 == F.col("next_seq"))
    problem = F.when(F.col("next_seq").isNull(), "MISSING_SHARD").when(F.col("ready_at") < due, "EARLY_MARKER").when(~F.coalesce(whole, F.lit(False)), "GAP")
    return both.select("shard", problem.alias("problem")).where("problem IS NOT NULL")


def late_rows(spark: SparkSession, path: str, as_of: datetime, at: str = "ts") -> DataFrame:
    """The stored rows of before ``as_of`` that the marker's batches do not hold: a recompute would differ by them."""
    found = marker(spark, path)
    rows = spark.read.parquet(path)
    if found is None:
        return rows.where(F.lit(False))
    as_of = as_of if as_of.tzinfo else as_of.replace(tzinfo=UTC)
    return rows.join(F.broadcast(found.agg(F.max("batch").alias("_until"))), F.lit(True)).where((F.col("batch") >= F.col("_until")) & (F.col(at) < F.lit(as_of.isoformat()).cast("timestamp"))).drop("_until")  # one row


def first_ready(rows: DataFrame, shards: DataFrame, instant, at: str = "ts") -> DataFrame:
    """``batch, watermark``: the first batch that may begin ready, from stored rows (batch, shard, ``at``); no row while a shard has not passed.

    That is the batch behind the one in which the last of the shards passes the instant;
    ``watermark`` is the least of the shards' latest times up to there.
    """
    one = F.lit(0).alias("_run")
    return first_ready_each(rows.select("*", one), shards.select("*", one), ["_run"], instant, at).drop("_run")


def first_ready_each(rows: DataFrame, shards: DataFrame, run: list[str], instant, at: str = "ts") -> DataFrame:
    """:func:`first_ready` of every capture: ``rows`` and ``shards`` have the columns ``run``, which ``instant`` may depend on."""
    passed = rows.where(F.col(at) >= instant).groupBy(*run, "shard").agg(F.min("batch").alias("_b"))
    last = shards.join(passed, [*run, "shard"], "left").groupBy(*run).agg(F.count_if(F.col("_b").isNull()).alias("_open"), F.max("_b").alias("_b")).where("_open = 0").drop("_open")
    upto = rows.join(last, run).where(F.col("batch") <= F.col("_b")).groupBy(*run, "shard", "_b").agg(F.max(at).alias("_m"))
    return upto.groupBy(*run, "_b").agg(F.min("_m").alias("watermark")).select(*run, (F.col("_b") + 1).alias("batch"), "watermark")
