"""Exact top-k search (operator 4): tiled matrix products, partial selection per tile, tree merging.

Vectors are packed into binary pieces where they are read and dealt to lanes, so no single
vector is shuffled and no id or vector, however often it stands, decides where a row goes.
A tile is a lane's shard against one block of queries: its task multiplies the two integer
matrices, keeps k rows per query, and the per-tile lists are merged in levels of bounded
fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, short_batches, table

#: Lanes that a table of few rows is dealt over.
SPREAD = 48
#: The most rows of a piece.
PIECE = 512
#: The greatest score that a long holds and that is told apart from one beyond.
MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, more: dict[str, Column] | None = None) -> DataFrame:
    """``vec_id, q`` and the columns of ``more``: each component x as floor(scale * x), x taken as double; the result is a double that holds an integer.

    A null vector or id, or a vector with a null or non-finite component takes no part.
    Every other row stays, also one that repeats another and one of large components.
    """
    wide = F.transform(column(vector), lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    exact = float(1 << 52)  # from here on a double is an integer
    scaled = F.transform("_w", lambda x: F.when(F.abs(x * scale) < exact, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return (
        vectors.select(column(vec_id).alias("vec_id"), wide.alias("_w"), *[c.alias(n) for n, c in (more or {}).items()])
        .where(F.col("vec_id").isNotNull() & F.col("_w").isNotNull() & good)
        .select("vec_id", scaled.alias("q"), *(more or {}))
    )


def as_bytes(m: np.ndarray) -> bytes:
    """A matrix of integers held in doubles: as int32 where that holds it, else as it is."""
    return (m.astype(np.int32) if _most(m) < 1 << 31 else m).tobytes()


def as_matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """The matrix of :func:`as_bytes`, in doubles; its length tells which form it has."""
    return np.frombuffer(raw, np.float64 if dim and len(raw) == 8 * rows * dim else np.int32).reshape(rows, dim).astype(np.float64)


def _most(m: np.ndarray) -> int:
    """The greatest absolute component, as a Python integer."""
    return int(np.abs(m).max(initial=0.0))


def lanes_for(rows: int, shard_rows: int) -> int:
    """How many lanes a table is dealt over; a small one still makes some tens of tasks."""
    return max(1, -(-rows // shard_rows), min(SPREAD, rows // 512))


def pieces(vectors: DataFrame, lanes: int, rows: int, longs: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``dim, lane, ids, <longs>, m``: some of the vectors of one number of components that one task has read.

    A task deals its pieces to the lanes in turn.
    """
    most = max(16, min(PIECE, rows // (4 * lanes)))
    names = ["vec_id", *longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        turn = part * 7919
        for batch in batches:
            lists = batch.column("q")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            own = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
            out: list[tuple] = []
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for cut in range(0, len(at), most):
                    some = at[cut : cut + most]
                    m = flat[(starts[some][:, None] + np.arange(dim)).reshape(-1)].reshape(len(some), dim) if dim else np.zeros((len(some), 0))
                    out.append((int(dim), turn % lanes, *(x[some].tobytes() for x in own), as_bytes(m)))
                    turn += 1
            if out:
                columns = list(zip(*out))
                types = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["dim", "lane", "ids", *longs, "m"])

    return vectors.select("q", *[F.col(n).cast("long").alias(n) for n in names]).mapInArrow(run, "dim int, lane int, ids binary, " + "".join(f"{n} binary, " for n in longs) + "m binary")


def blocks(queries: DataFrame, count: int) -> DataFrame:
    """Rows ``dim, block, ids, m``: the queries dealt into blocks by their hash; equal rows are one query."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        dim = int(pdf["dim"].iloc[0])
        m = np.stack(pdf["q"].to_numpy()) if dim else np.zeros((len(pdf), 0))
        return pd.DataFrame({"dim": [dim], "block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "m": [as_bytes(m)]})

    no = F.pmod(F.xxhash64("vec_id", "q"), F.lit(count)).cast("int")
    return queries.select("vec_id", "q").distinct().select("vec_id", "q", F.size("q").alias("dim"), no.alias("block")).groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, m binary")


def products(block: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The exact inner products of integers held in doubles, of int64; one that leaves 64 bits is ``MOST`` or ``-MOST``."""
    dim = block.shape[1]
    bound = dim * (_most(block) + 1) * (_most(shard) + 1)
    if bound < 1 << 53:  # doubles are exact there, and BLAS multiplies them
        return (block @ shard.T).astype(np.int64)
    if bound < 1 << 62:
        return block.astype(np.int64) @ shard.astype(np.int64).T
    # some vectors are large: the products of the others as before, theirs by Python's integers
    tall, wide = (np.array([_most(row) >= 1 << 15 for row in m], bool) for m in (block, shard))
    out = np.zeros((len(block), len(shard)), np.int64)
    if not (tall.all() or wide.all()):
        out[np.ix_(~tall, ~wide)] = products(block[~tall], shard[~wide]) if dim < 1 << 20 else block[~tall].astype(np.int64) @ shard[~wide].astype(np.int64).T
    a, b = ([[int(x) for x in row] for row in m] for m in (block, shard))
    for i, j in np.argwhere(tall[:, None] | wide[None, :]):
        out[i, j] = max(-MOST, min(MOST, sum(x * y for x, y in zip(a[i], b[j]))))
    return out


def in_bits(score: Column) -> Column:
    """The score, or an error if it stands for one that leaves 64 bits."""
    return F.when(F.abs(score) >= MOST, F.raise_error(F.lit("a score leaves 64 bits")).cast("long")).otherwise(score)


def best_of_tile(block_ids, block: np.ndarray, shard_ids, shard: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, score) of each query's k best rows of one tile, those of its own id left out."""
    scores = products(block, shard)
    out = []
    for i, query in enumerate(block_ids):
        other = shard_ids != query
        row = scores[i]
        keep = min(len(row), k + len(row) - int(other.sum()))  # more by the own rows, which may be among them
        floor = np.partition(row, len(row) - keep)[len(row) - keep]
        at = np.flatnonzero((row >= floor) & other)
        at = at[np.lexsort((shard_ids[at], -row[at]))][:k]
        out.append((np.full(len(at), query), shard_ids[at], row[at]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def merged(best: DataFrame, keys: list[str], k: int, parts: int, fan_in: int = 32) -> DataFrame:
    """``<keys>, rank, vec_id, score`` of the k best (score, then smaller id) of all ``part``s' lists, merged ``fan_in`` parts at a time."""
    entry = F.struct((-F.col("score")).alias("low"), "vec_id")
    lists = best.groupBy(*keys, F.floor(F.col("part") / fan_in).alias("part")).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
    width = -(-parts // fan_in)
    while width > 1:  # each level merges the lists of at most fan_in parts
        lists = lists.groupBy(*keys, F.floor(F.col("part") / fan_in).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        width = -(-width // fan_in)
    return lists.select(*keys, F.posexplode("top").alias("_at", "_t")).select(
        *keys, (F.col("_at") + 1).cast("int").alias("rank"), F.col("_t.vec_id").alias("vec_id"), in_bits(-F.col("_t.low")).alias("score")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16384, block_rows: int = 64, fan_in: int = 32, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k rows of the greatest inner product.

    Both inputs have ``vec_id, q`` as from :func:`quantised`; ties go to the smaller
    id, and a query never meets a row of its own id.  Every row is a candidate, repeated
    ones too; as queries, vectors of one id share one list and equal ones count once.
    Vectors with differing numbers of components do not meet.  A query without partners has
    no rows; an empty table gives none.  Products are exact whatever the components; a
    score among the k that leaves 64 bits is an error.  Further columns are ignored.

    ``shard_rows`` and ``block_rows`` set the expected rows of a tile's sides; ``sizes`` saves
    counting the rows of the two inputs.  A vector moves once, with the piece it was read
    in, and stays in its lane's memory; a copy of every block streams past each lane, so
    what moves is the queries times the lanes.
    """
    n, m = sizes or (vectors.count(), queries.count())
    lanes = lanes_for(n, shard_rows)
    shard = pieces(vectors, lanes, n).withColumn("block", F.lit(-1))
    block = blocks(queries, max(1, -(-m // block_rows))).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = short_batches(shard.select("lane", "block", "dim", "ids", "m").unionByName(block.select("lane", "block", "dim", "ids", "m")))
    both = both.repartition(lanes, "lane").sortWithinPartitions("lane", "block")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for lane, no, dim, ids, m in zip(*(batch.column(c).to_pylist() for c in ("lane", "block", "dim", "ids", "m"))):
                if lane != at:
                    at, held = lane, {}
                ids = np.frombuffer(ids, np.int64)
                m = as_matrix(m, len(ids), dim)
                if no < 0:  # a lane's pieces come before the blocks
                    held.setdefault(dim, []).append((ids, m))
                elif dim in held:  # else no vector of the lane has so many components
                    if len(held[dim]) > 1:
                        held[dim] = [tuple(np.concatenate(x) for x in zip(*held[dim]))]
                    query, vec, score = best_of_tile(ids, m, *held[dim][0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, vec, score)] + [pa.array(np.full(len(query), at, np.int32))], ["query_id", "vec_id", "score", "part"])

    return merged(both.mapInArrow(multiply, "query_id long, vec_id long, score long, part int"), ["query_id"], k, lanes, fan_in)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's five best partners among all vectors."""
    every = table(spark, sf_dir, "embeddings")
    sizes = (every.count(), every.where("vec_id % 50 = 0").count())
    rows = quantised(every)
    return top_k(rows, quantised(every.where("vec_id % 50 = 0")), sizes=sizes)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t
WHERE rank <= 5
"""
