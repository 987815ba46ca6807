"""Incremental operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICKS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, path: str, schema: str = TICKS, files_per_batch: int = 10) -> DataFrame:
    """New files of a folder as a stream: each micro-batch is one committed run."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(ticks: DataFrame, key: list[str], at: str, delay: str = "5 minutes") -> DataFrame:
    """The first of each key within the watermark; repeats are dropped, state is bounded by the delay."""
    return ticks.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def window_bars(ticks: DataFrame, width: str = "1 hour", delay: str = "5 minutes") -> DataFrame:
    """Bars that are emitted once they are final: their end and the settling delay have passed."""
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), F.col("event_type").alias("key"))
    return bars.agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    ).select("key", F.col("window.start").alias("bucket"), "open", "high", "low", "close", "volume")


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there into Parquet and stop; offsets in the checkpoint make reruns pick up behind it."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def append_batches(stream: DataFrame, path: str, checkpoint: str, ready_at: str | None = None):
    """Append each micro-batch with its id, under ``path/batch=N``; a row before ``ready_at`` is late if an earlier batch passed that instant.

    The marker of readiness is stored beside the batches: the id of the first batch that held
    a row at or after ``ready_at``.  Late rows are stored and marked, never dropped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        late = F.lit(False)
        if ready_at is not None:
            instant = F.lit(ready_at).cast("timestamp")
            ready = ready_batch(spark, path)
            late = (F.col("ts") < instant) & F.lit(ready is not None and ready < batch_id)
            if ready is None and not batch.where(F.col("ts") >= instant).isEmpty():
                # a batch that is run again finds its own id, and marks nothing late by it
                spark.createDataFrame([(batch_id,)], "batch_id long").coalesce(1).write.mode("overwrite").parquet(f"{path}-ready")
        # a batch that is run again overwrites its own folder
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ready_batch(spark: SparkSession, path: str) -> int | None:
    """The id of the first batch that passed the ready instant, or None."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}-ready").agg(F.min("batch_id")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """``batch, rows, late`` of what :func:`append_batches` stored."""
    return spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("rows"), F.count_if("late").alias("late"))


def split_repeats(batch: DataFrame, stored: DataFrame, keys: list[str], values: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch to add, and its conflicts: a key that is stored, or came earlier in the batch, with other values.

    Equal repeats are neither.  Of a batch's rows of one key the first in ``order`` stands.
    """
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_first"))
    known = stored.select(*keys, F.struct(*values).alias("_stored"))
    both = batch.join(first, keys).join(known, keys, "left").withColumn("_own", F.struct(*values))
    holds = F.coalesce("_stored", "_first")
    conflicts = both.where(~F.col("_own").eqNullSafe(holds)).select(*batch.columns)
    new = both.where(F.col("_stored").isNull()).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_row"))
    return new.select(*keys, "_row.*").select(*batch.columns), conflicts


def poll_split(poll: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """A poll's items with ``state``: NEW, SEEN (stored with the same content) or CHANGED."""
    old = stored.select(key, F.col(content).alias("_old"))
    state = F.when(F.col("_old").isNull(), "NEW").when(F.col(content) == F.col("_old"), "SEEN").otherwise("CHANGED")
    return poll.join(old, key, "left").withColumn("state", state).drop("_old")


TRACK_SCHEMA = "plan_id long, kind string, at timestamp, price double"
STATE_SCHEMA = "done array<string>"


def levels_crossed(plan: dict, done: set[str], price: float) -> list[str]:
    """The events that a price makes for a plan, given those it has had: ENTRY, then T1, T2 or STOP, each once."""
    if "STOP" in done or "T2" in done:
        return []
    if "ENTRY" not in done:
        return ["ENTRY"] if plan["entry_low"] <= price <= plan["entry_high"] else []
    if price <= plan["stop"]:
        return ["STOP"]
    return [k for k, level in (("T1", plan["t1"]), ("T2", plan["t2"])) if price >= level and k not in done]


def track(prices: DataFrame, idle: str | None = None) -> DataFrame:
    """Events of each plan as its prices stream in: ``plan_id, kind, at, price``.

    ``prices``: plan_id, entry_low, entry_high, t1, t2, stop, ts, price (a stream joined to its static
    plans).  Prices of one time are taken in their own order.  The state per plan is the set
    of events it has had; once a plan is closed its state is a single mark, so that prices which still come
    make no new entry, and with ``idle`` (as "1 day") a plan without prices for so long is forgotten.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = set(state.get[0]) if state.exists else set()
        rows = []
        for pdf in parts:
            for r in pdf.sort_values(["ts", "price"]).itertuples(index=False):
                for kind in levels_crossed(r._asdict(), done, r.price):
                    done.add(kind)
                    rows.append((key[0], kind, r.ts, r.price))
        closed = {"STOP", "T2"} & done
        state.update((sorted(closed or done),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(rows, columns=["plan_id", "kind", "at", "price"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return prices.groupBy("plan_id").applyInPandasWithState(step, TRACK_SCHEMA, STATE_SCHEMA, "append", timeout)


def track_batch(prices: DataFrame) -> DataFrame:
    """The same events over a finished table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done: set[str] = set()
        rows = []
        for r in pdf.sort_values(["ts", "price"]).itertuples(index=False):
            for kind in levels_crossed(r._asdict(), done, r.price):
                done.add(kind)
                rows.append((r.plan_id, kind, r.ts, r.price))
        return pd.DataFrame(rows, columns=["plan_id", "kind", "at", "price"])

    return prices.groupBy("plan_id").applyInPandas(run, TRACK_SCHEMA)
