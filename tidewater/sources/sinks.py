"""Append-only tables with compare on rewrite, and the run ledger."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.pit import insert_if_absent


class Conflict(RuntimeError):
    """A rewritten row differs from the stored one."""


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append(new: DataFrame, path: str, keys: list[str], values: list[str], partition_by: list[str] = ()) -> int:
    """Append the rows whose keys are not stored; refuse the write when a stored row differs.  Returns the rows added."""
    stored = read_or_none(new.sparkSession, path)
    absent = new
    if stored is not None:
        absent, conflicts = insert_if_absent(stored, new, keys, values)
        if not conflicts.isEmpty():
            raise Conflict(f"{conflicts.count()} rows differ from those stored at {path}")
    absent = absent.observe(watch := Observation(), F.count(F.lit(1)).alias("n"))
    absent.write.mode("append").partitionBy(*partition_by).parquet(path)
    return watch.get["n"]


def record_run(spark: SparkSession, path: str, run_id: str, stream: str, status: str, rows: int) -> None:
    """A line of the run ledger."""
    line = spark.createDataFrame([(run_id, stream, status, rows)], "run_id string, stream string, status string, rows long")
    line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def advance(checkpoints: DataFrame, windows: DataFrame) -> DataFrame:
    """Move each stream's ``through`` over the windows (start, end) that follow it without a gap."""
    joined = checkpoints.join(windows.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_w")), "stream", "left")
    through = F.aggregate(
        F.coalesce("_w", F.array().cast("array<struct<start:date,end:date>>")),
        F.col("through"),
        lambda t, w: F.when(w["start"] <= F.date_add(t, 1), F.greatest(t, w["end"])).otherwise(t),
    )
    return joined.withColumn("through", through).drop("_w")
