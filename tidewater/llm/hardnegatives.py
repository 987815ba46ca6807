"""Hard-negative mining by norm-bucketed search (operator 12).

Two searches of one kind.  The first finds each anchor's positives, the best rows of its own
label; the second the best rows of other labels inside a window of scores below each
positive's.  In a lane the candidates are sorted by norm, longest first, and cut into
buckets.  No product of an anchor with a bucket exceeds the anchor's norm times the bucket's
longest, so a bucket is passed over, and with it all that follow, once that bound is
under the window's lower limit or under the k-th score that the lane has found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, scratch, stored, table
from .topk import MOST, as_bytes, as_matrix, lanes_for, merged, pieces, products, quantised

#: Rows of a bucket.
BUCKET = 1024


def norms(m: np.ndarray) -> np.ndarray:
    """Upper bounds of the rows' lengths: the rounding of a double is added on top."""
    return np.sqrt((m * m).sum(axis=1)) * (1 + 1e-9)


class Lane:
    """A lane's candidates of one number of components, by norm, in buckets."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, bucket: int = BUCKET):
        length = norms(m)
        order = np.argsort(-length, kind="stable")
        self.ids, self.labels, self.m, length = ids[order], labels[order], m[order], length[order]
        self.cuts = [(a, min(a + bucket, len(ids)), float(length[a])) for a in range(0, len(ids), bucket)]
        self.met = 0  # products formed, for tests

    def search(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, ids, scores) of the k best rows of the same (or another) label for each anchor's windows ``low .. high``."""
        length = norms(m)
        n, windows = low.shape
        best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(windows)] for _ in range(n)]
        # what a score has to reach: the window's lower limit, later the k-th score if that is more; an empty window wants nothing
        floor = np.where(low <= high, low, MOST)
        wanted = low <= high
        for a, b, longest in self.cuts:
            with np.errstate(over="ignore"):
                active = np.flatnonzero((wanted & (floor <= length[:, None] * longest)).any(1))
            if not len(active):
                break  # later buckets are shorter
            scores = products(m[active], self.m[a:b])
            self.met += scores.size
            fits = (self.labels[a:b][None, :] == labels[active][:, None]) == same
            fits &= self.ids[a:b][None, :] != ids[active][:, None]
            for i, row, good in zip(active, scores, fits):
                for w in range(windows):
                    if not wanted[i, w]:
                        continue
                    at = np.flatnonzero(good & (row >= floor[i, w]) & (row <= high[i, w]))
                    if not len(at):
                        continue
                    own, score = (np.concatenate(x) for x in zip(best[i][w], (self.ids[a:b][at], row[at])))
                    first = np.lexsort((own, -score))[:k]
                    best[i][w] = own[first], score[first]
                    if len(first) == k:
                        floor[i, w] = max(floor[i, w], score[first[-1]])
        return [(i, w, *best[i][w]) for i in range(n) for w in range(windows) if len(best[i][w][0])]


def _blocks(anchors: DataFrame, count: int) -> DataFrame:
    """Anchors (uid, vec_id, label, q, low, high) as rows ``dim, block, ids, m, uid, label, low, high``."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        dim = int(pdf["dim"].iloc[0])
        m = np.stack(pdf["q"].to_numpy()) if dim else np.zeros((len(pdf), 0))
        width = max(len(x) for x in pdf["low"])
        low, high = np.zeros((len(pdf), width), np.int64), np.full((len(pdf), width), -1, np.int64)
        for i, (x, y) in enumerate(zip(pdf["low"], pdf["high"])):
            low[i, : len(x)], high[i, : len(x)] = x, y
        longs = {n: [pdf[c].to_numpy(np.int64).tobytes()] for n, c in (("ids", "vec_id"), ("uid", "uid"), ("label", "label"))}
        return pd.DataFrame({"dim": [dim], "block": [int(pdf["block"].iloc[0])], "m": [as_bytes(m)], "low": [low.tobytes()], "high": [high.tobytes()]} | longs)

    placed = anchors.withColumns({"dim": F.size("q"), "block": F.pmod("uid", F.lit(count)).cast("int")})
    return placed.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, m binary, low binary, high binary, ids binary, uid binary, label binary")


def _search(candidates: DataFrame, anchors: DataFrame, lanes: int, count: int, same: bool, k: int) -> DataFrame:
    """``uid, window, rank, vec_id, score``: the k best in each window of each anchor."""
    block = _blocks(anchors, count).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    names = ["lane", "block", "dim", "ids", "label", "m", "uid", "low", "high"]
    none = [F.lit(None).cast("binary").alias(n) for n in ("uid", "low", "high")]
    both = candidates.select("lane", F.lit(-1).alias("block"), "dim", "ids", "label", "m", *none).unionByName(block.select(*names))
    both = both.repartition(lanes, "lane").sortWithinPartitions("lane", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, read, built = None, {}, {}
        for batch in batches:
            for lane, no, dim, ids, label, m, uid, low, high in zip(*(batch.column(c).to_pylist() for c in names)):
                if lane != at:
                    at, read, built = lane, {}, {}
                ids, label = (np.frombuffer(x, np.int64) for x in (ids, label))
                m = as_matrix(m, len(ids), dim)
                if no < 0:  # a lane's candidates come before the anchors
                    read.setdefault(dim, []).append((ids, label, m))
                    continue
                if dim in read:
                    built[dim] = Lane(*(np.concatenate(x) for x in zip(*read.pop(dim))))
                if dim not in built:  # no vector of the lane has so many components
                    continue
                uid = np.frombuffer(uid, np.int64)
                low, high = (np.frombuffer(x, np.int64).reshape(len(ids), -1) for x in (low, high))
                found = built[dim].search(ids, label, m, low, high, same, k)
                if found:
                    sizes = [len(x[2]) for x in found]
                    columns = [np.repeat([uid[i] for i, *_ in found], sizes), np.repeat([w for _, w, *_ in found], sizes).astype(np.int32), *(np.concatenate([x[c] for x in found]) for c in (2, 3))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(sum(sizes), at, np.int32))], ["uid", "window", "vec_id", "score", "part"])

    best = both.mapInArrow(run, "uid long, window int, vec_id long, score long, part int")
    return merged(best, ["uid", "window"], k, lanes)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, shard_rows: int = 16384, block_rows: int = 64, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both inputs have ``vec_id, label, q`` with ``q`` as from :func:`quantised`.  An anchor's
    positives are its ``positives`` best rows of the same label, its negatives for each of them
    the ``negatives`` best rows of another label whose score lies between ``low`` and ``high``
    hundredths of the positive's, both included; so a negative positive's window is empty.
    Scores are integer inner products; ties go to the smaller id.

    A null id or label takes no part.  A row never meets an anchor of its own id.  Every row
    is a candidate, repeated ones too; equal anchors are one, anchors of one id with
    differing labels or vectors are several with rows of their own.  Vectors with
    differing numbers of components do not meet.  A returned score that leaves 64 bits is
    an error.  Further columns are ignored; an empty table gives no rows.

    Candidates are dealt to lanes in the pieces they are read in, whatever their labels and
    norms, so no label, vector or norm makes a lane large; every block of anchors meets
    every lane.
    """
    keyed = lambda df: df.select("vec_id", F.col("label").cast("long").alias("label"), "q").where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows, anchors = keyed(rows), keyed(anchors)
    n, m = sizes or (rows.count(), anchors.count())
    lanes, count = lanes_for(n, shard_rows), max(1, -(-m // block_rows))
    anchors = anchors.distinct().withColumn("uid", F.xxhash64("vec_id", "label", "q"))
    candidates = pieces(rows, lanes, n, ("label",))
    every = lambda bound: F.array(F.lit(bound).cast("long"))
    with scratch() as keep:
        first = _search(candidates, anchors.withColumns({"low": every(-MOST), "high": every(MOST)}), lanes, count, True, positives)
        found = stored(first.select("uid", (F.col("rank") - 1).cast("int").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        # decimals, as a multiple of a score may leave 64 bits
        wide = F.col("positive_score").cast("decimal(22,0)")
        limits = found.select("uid", "window", F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high"))
        listed = limits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("window", "low", "high"))).alias("_w")).select("uid", F.col("_w.low").alias("low"), F.col("_w.high").alias("high"))
        second = _search(candidates, anchors.join(listed, "uid"), lanes, count, False, negatives)
        whole = second.join(found, ["uid", "window"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
        return keep(stored(whole.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth vector among all, every seventh label being moved on by one."""
    every = table(spark, sf_dir, "embeddings")
    label = F.when(column("vec_id") % 7 == 0, (column("label") + 1) % 10).otherwise(column("label"))
    own = lambda df: quantised(df, more={"label": label})
    chosen = every.where("vec_id % 50 = 0")
    return hard_negatives(own(every), own(chosen), sizes=(every.count(), chosen.count()))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
  SELECT *, row_number() OVER () AS uid FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0)
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS HUGEINT) AS score
  FROM anchors a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
), ranked AS (
  SELECT p.uid, p.anchor_id, p.vec_id AS positive_id, p.r, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.uid, p.r ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN s n ON n.uid = p.uid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM ranked WHERE rank <= 3
"""
