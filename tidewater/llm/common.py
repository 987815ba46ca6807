"""Shared pieces of the training-data operators: tables, durable cuts, bitmap filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task's numpy code handles at once; its arrays take some 60 times that.
SLICE_BYTES = 1 << 18
#: Rows of text that Spark hands to Python at once, and that it reads from Parquet at once; its own limits (10,000 and
#: 4,096 rows) are meant for short ones, and the arrays of such batches are so large that they fragment an executor's heap.
BATCH_ROWS, READ_ROWS = 1000, 512
#: Bytes that a writer of an intermediate table gathers before it writes them out.
ROW_GROUP = 16 << 20
#: A task that writes an intermediate table has so many bytes of what is read for it, or a table has this many files a core.
FILE_BYTES, FILES_PER_CORE = 64 << 20, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (local tests) is a temporary folder made and set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidewater-checkpoints-")
            context.setCheckpointDir(folder)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


#: Spark's setting that drops a query's shuffle files once it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Scratch:
    """The tables and broadcasts of an open :func:`scratch`, and the one around it."""

    def __init__(self, around: _Scratch | None):
        self.around, self.tables, self.sent = around, [], []


#: The innermost open scratch of this thread: queries of other threads have their own.
_SCRATCH: ContextVar[_Scratch | None] = ContextVar("scratch", default=None)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote."""
    for df in tables:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete a stored table ahead of its scratch."""
    own = _SCRATCH.get()
    while own:
        own.tables[:] = [x for x in own.tables if x is not df]
        own = own.around
    drop(df)


@contextmanager
def scratch():
    """Tables that :func:`stored` writes inside are deleted when the block ends, and broadcasts are released, but for a table that goes through the yielded function.

    What leaves the block is stored last and handed out by that function; a block around
    this one then owns it.
    """
    own = _Scratch(_SCRATCH.get())
    token = _SCRATCH.set(own)

    def keep(df: DataFrame) -> DataFrame:
        own.tables[:] = [x for x in own.tables if x is not df]
        if own.around:
            own.around.tables.append(df)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for sent in own.sent:
            sent.unpersist()
        drop(*own.tables)


def broadcast(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of bounded size; executors and their Python workers let go of it when the scratch ends."""
    sent = spark.sparkContext.broadcast(value)
    if own := _SCRATCH.get():
        own.sent.append(sent)
    return sent


def read_bytes(df: DataFrame) -> int:
    """How large the tables are that a plan reads, together."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Many small partitions are written by few tasks, but by one at least for every
    ``FILE_BYTES`` that the plan reads, however few cores there are just then: so no
    task grows with the input.  Nothing reads the write's shuffles a second time, so their
    files go when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidewater-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        files = max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, read_bytes(df) // FILE_BYTES)
        df.coalesce(min(files, (1 << 31) - 1)).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    if own := _SCRATCH.get():
        own.tables.append(back)
    return back


def short_batches(df: DataFrame) -> DataFrame:
    """Bound the session's Arrow batches at ``BATCH_ROWS`` rows and its Parquet batches at ``READ_ROWS``, unless they are smaller already."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < int(conf.get(key)) <= most:
            conf.set(key, most)
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice have about ``most`` bytes (one row at least); at the end, Arrow gives back what it no longer uses."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # Spark's Python workers live on for other tasks


class Bitmap:
    """A fixed-size set of 64-bit hashes: no false negatives, some false positives.

    It only thins what is shuffled; exact joins follow it, so results do not
    depend on how full it is.  ``bits`` bounds what is broadcast (2**25 bits are
    4 MiB) whatever the size of the corpus; a larger one suits a larger corpus.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.mask = words, np.uint64((1 << bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) & self.mask
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(hashes: DataFrame, column: str, bits: int = 25):
    """Broadcast a :class:`Bitmap` of a bigint column's values.

    Spark builds 4 KiB bitmaps per 32,768 positions with map-side combination; the
    driver receives 2**bits / 8 bytes at most.
    """
    spark = hashes.sparkSession
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        hashes.where(F.col(column).isNotNull())
        .select(at.alias("_at"))
        .groupBy(F.shiftright("_at", 15).alias("_page"))
        .agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit((1 << 15) - 1))).alias("_bits"))
    )
    words = np.zeros(1 << (bits - 3), np.uint8)
    for page, raw in rows.toLocalIterator(prefetchPartitions=True):
        words[page << 12 : (page << 12) + len(raw)] = np.frombuffer(raw, np.uint8)
    return broadcast(spark, Bitmap(words, bits))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), smallest node first.

    Alternates large-star and small-star rewiring; each round is a pair of
    aggregations with map-side combination and ends in a written table, so neither
    the driver nor any task holds a component.  Nodes without edges do not appear.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct())
    if links.isEmpty():
        return links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    before = None
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u hang on u's smallest neighbour
        large = both.join(lowest, "u").where("v > u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        # small star: neighbours at or below v hang on the smallest of them
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        done = links
        links = stored(
            joined.where("u <> m")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(small.select("v", F.col("m").alias("u")))
            .where("v <> u")
            .distinct()
        )
        forget(done)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    return links.select(F.col("v").alias("node"), F.col("u").alias("component"))
