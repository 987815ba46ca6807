"""Stories of a stream of articles: the state of each key is the articles of its last hours.

Two steps.  A stateful operator keeps, for each key under which articles meet, the members of
the window as a list, and gives every new article its best earlier one under that key.  What
an article's keys found is then put together batch by batch, and its story is that of its
best match: found in the stored stories, or by following matches inside the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import stories as S

MEMBER = "item_id long, url string, title_hash string, strict boolean, words array<string>, companies array<string>, entities array<string>, category string, at long, knowable_at long"
FOUND = "item_id long, knowable_at timestamp, parent_id long, parent_known long, score double, method string"
HOUR = 3_600_000_000


def judge(m: dict, c: dict) -> tuple[float, str] | None:
    """Score and method of two items, by the rules of :func:`stories.evidence`."""
    if m["url"] and m["url"] == c["url"]:
        return S.SAME_URL, "SAME_URL"
    if m["title_hash"] is not None and m["title_hash"] == c["title_hash"]:
        return S.SAME_TITLE, "SAME_TITLE"
    if m["strict"] or c["strict"] or not m["words"] or not c["words"]:
        return None
    shared = len(m["words"] & c["words"])
    j = shared / (len(m["words"]) + len(c["words"]) - shared)
    hours = _tenths(abs(m["at"] - c["at"])) / 60
    company, entity = bool(m["companies"] & c["companies"]), bool(m["entities"] & c["entities"])
    category = m["category"] is not None and m["category"] == c["category"] != "OTHER"
    alone = not m["companies"] and not c["companies"]
    for (least, most), also in ((S.COMPANY_AND_CATEGORY, company and category), (S.COMPANY, company), (S.ENTITY_AND_CATEGORY, alone and entity and category), (S.ENTITY, alone and entity), (S.WORDING, True)):
        if also and j >= least and hours <= most:
            return round(j, 4), "SIMILAR"
    return None


def _tenths(micros: int) -> float:
    """Minutes to a tenth, halves up."""
    return (micros * 2 // 6_000_000 + 1) // 2 / 10


class Meetings(StatefulProcessor):
    """Under one key: the members of the last hours, and each new item's best among them.

    Members are dropped as new ones come, and all of them once the watermark has passed the
    time for which the last is remembered, so a key that falls silent keeps no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getListState("members", MEMBER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [dict(zip(S.FIELDS, x)) for x in self.members.get()]
        for x in held:
            x.update({c: frozenset(x[c] or ()) for c in ("words", "companies", "entities")})
        new = pd.concat(list(rows)).sort_values(["knowable_at", "item_id"])
        out = []
        for r in new[S.FIELDS].itertuples(index=False):
            m = r._asdict() | {c: frozenset(getattr(r, c)) for c in ("words", "companies", "entities")}
            m |= {c: int(pd.Timestamp(m[c]).value // 1000) for c in ("at", "knowable_at")}
            held = [c for c in held if m["knowable_at"] - c["at"] <= S.REMEMBERED_HOURS * HOUR]
            best = None
            for c in held:  # in their order: of equal scores the first stays
                said = judge(m, c) if abs(m["at"] - c["at"]) <= S.WINDOW_HOURS * HOUR else None
                if said and (best is None or said[0] > best[2]):
                    best = (c["item_id"], c["knowable_at"], *said)
            out.append((m["item_id"], r.knowable_at, *(best or (None, None, None, None))))
            held.append(m)
        if held:
            self.members.put([tuple(sorted(x[f]) if isinstance(x[f], frozenset) else x[f] for f in S.FIELDS) for x in held])
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(max(c["at"] for c in held) // 1000 + S.REMEMBERED_HOURS * 3_600_000)
        else:
            self.members.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")]).astype({"parent_id": "Int64", "parent_known": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.members.clear()
        yield from ()

    def close(self) -> None:
        pass


def meetings(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream of ``FOUND`` rows: for every item one per key, with its best earlier item under it."""
    base = S.cleaned(items).withWatermark("knowable_at", delay)
    keyed = base.withColumn("key", F.explode(S.keys(base)))
    return keyed.groupBy("key").transformWithStateInPandas(Meetings(), FOUND, "append", "EventTime")


def stored(spark, path: str) -> DataFrame | None:
    """The stories so far, or None before the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_batch(found: DataFrame, batch_id: int, path: str) -> None:
    """Add a batch's items to the stories under ``path``: ``item_id, story_id, method, score, with_id, knowable_at``, parted by day and batch.

    A batch that is run again finds the earlier batches as they were and overwrites its own
    partitions.  Of the stored stories only the days are read that an item can still match.
    """
    spark = found.sparkSession
    order = F.struct(-F.col("score"), "parent_known", "parent_id")
    hit = F.col("score").isNotNull()
    best = found.groupBy("item_id").agg(F.min("knowable_at").alias("knowable_at"), F.min_by(F.when(hit, F.struct("parent_id", "score", "method")), F.when(hit, order)).alias("b")).select("item_id", "knowable_at", "b.*")
    at = S.scratch(spark, "story-batch")
    best.write.parquet(at)
    best = spark.read.parquet(at)
    first = best.agg(F.min("knowable_at")).first()[0]
    if first is None:
        return
    # inside the batch: up to the first item that founds a story or matches an earlier batch
    own = best.select(F.col("item_id").alias("parent_id"))
    top = S.roots(best.where("parent_id IS NOT NULL").join(own, "parent_id", "left_semi"))
    placed = best.join(top, "item_id", "left").withColumn("root_id", F.coalesce("root_id", "item_id"))
    outer = best.join(own.withColumnRenamed("parent_id", "_in"), F.col("parent_id") == F.col("_in"), "left").select(F.col("item_id").alias("root_id"), F.when(F.col("_in").isNull(), F.col("parent_id")).alias("outer_id"))
    placed = placed.join(outer, "root_id", "left")
    before = stored(spark, path)
    if before is not None:
        since = (first - timedelta(hours=2 * S.REMEMBERED_HOURS)).date()
        before = before.where((F.col("day") >= F.lit(since)) & (F.col("batch") < batch_id)).select(F.col("item_id").alias("outer_id"), F.col("story_id").alias("_story"))
        placed = placed.join(before, "outer_id", "left")
    else:
        placed = placed.withColumn("_story", F.lit(None).cast("long"))
    done = placed.select(
        "item_id", F.coalesce("_story", "root_id").alias("story_id"), F.coalesce("method", F.lit("FOUNDER")).alias("method"), F.coalesce("score", F.lit(1.0)).alias("score"), F.col("parent_id").alias("with_id"), "knowable_at",
        F.to_date("knowable_at").alias("day"), F.lit(batch_id).alias("batch"),
    )
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def run(items: DataFrame, path: str, checkpoint: str, delay: str = "1 hour"):
    """Assign stories to a stream of items until nothing is left; a rerun goes on behind the checkpoint.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).  Items have to
    come in the order in which they became known, up to the order inside a batch: then the stories
    are those of :func:`operators.stories.assign`, however the stream is cut.
    """
    query = meetings(items, delay).writeStream.foreachBatch(lambda df, n: write_batch(df, n, path)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
