"""Cross-section operators: ranks with averaged ties, bins, universes, matched cells, drawdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import orderstats


def average_rank(value: str, by: list[str]) -> Column:
    """1-based rank; equal values share the mean of their places."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def unit_rank(value: str, by: list[str]) -> Column:
    """Ranks stretched over [-0.5, 0.5]; 0 for a cross-section of one."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n < 2, 0.0).otherwise((average_rank(value, by) - 1) / (n - 1) - 0.5)


def bins(value: str, by: list[str], n: int = 10) -> Column:
    """Bins 0 to n - 1 of equal width in rank: equal values share a bin, unlike ntile."""
    return F.floor(F.least((unit_rank(value, by) + 0.5) * n, F.lit(n - 1e-9))).cast("int")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n per task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def top_share(df: DataFrame, by: list[str], order: list[Column], share: float) -> DataFrame:
    """The first int(share * rows) rows of each group."""
    w = Window.partitionBy(*by)
    placed = df.withColumns({"place": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return placed.where(F.col("place") <= F.floor(F.col("_n") * share)).drop("_n")


def matched_excess(df: DataFrame, by: list[str], cell: list[str], value: str, picked: str) -> DataFrame:
    """Each picked row's value less the mean of the rows of its cell that were not picked (null without any)."""
    pool = df.where(~F.col(picked)).groupBy(*by, *cell).agg(F.avg(value).alias("pool_mean"), F.count("*").alias("pool_n"))
    return df.where(F.col(picked)).join(pool, [*by, *cell], "left").withColumn("excess", F.col(value) - F.col("pool_mean"))


def peer_median(df: DataFrame, group: str, key: str, value: str, least: int = 3) -> DataFrame:
    """Each row's value less the median of the other members of its group (null with fewer than ``least``)."""
    return orderstats.peer_median(df, group, value, least)


def drawdown(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Running sum, and how far it stands below its highest point so far (never below a start of 0)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("equity", F.sum(value).over(w))
    return summed.withColumn("drawdown", F.greatest(F.max("equity").over(w), F.lit(0.0)) - F.col("equity"))


def cap_bucket(rank: Column) -> Column:
    """LARGE to place 100, MID to 250, then SMALL."""
    return F.when(rank <= 100, "LARGE").when(rank <= 250, "MID").otherwise("SMALL")


def psi(reference: DataFrame, current: DataFrame, value: str, n: int = 10) -> DataFrame:
    """Population stability index of ``current`` against the deciles of ``reference``: one row."""
    edges = reference.select(F.percentile(value, [i / n for i in range(1, n)]).alias("edges"))
    place = lambda df, name: (
        df.crossJoin(F.broadcast(edges)).groupBy(F.size(F.filter("edges", lambda e: e < F.col(value))).alias("bin")).agg(F.count("*").alias(name))
    )
    both = place(reference, "r").join(place(current, "c"), "bin", "full_outer").na.fill(0, ["r", "c"])
    total = Window.partitionBy(F.lit(0))  # n rows
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(total), F.lit(1e-6))
    both = both.select(share("r").alias("p"), share("c").alias("q"))
    return both.select(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def fingerprint(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """md5 over each group's row md5s in order."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    seq = F.array_sort(F.collect_list(F.struct(*order, row.alias("_h"))))
    return df.groupBy(*by).agg(F.md5(F.array_join(F.transform(seq, lambda x: x["_h"]), "").cast("binary")).alias("fingerprint"), F.count("*").alias("rows"))


def rank_sequences(rows: DataFrame, axis: DataFrame, features: list[str], length: int) -> DataFrame:
    """``session, key, present, sequence``: for every row the unit ranks of its key's features over the ``length`` sessions up to its own.

    ``rows``: session, key and features; ranks are within a session's rows.  ``axis`` has each
    session with its dense ``session_idx`` (as from :func:`pit.sessions`).  A session in which the
    key is absent, or that lies before the first, is a row of zeros; so is a null feature's rank.
    ``sequence`` is an array of ``length`` arrays, oldest first; ``present`` counts the sessions with a row.
    """
    ranks = F.array(*[F.coalesce(F.when(F.col(f).isNotNull(), unit_rank(f, ["session", f"_has_{f}"])), F.lit(0.0)) for f in features])
    marked = rows.withColumns({f"_has_{f}": F.col(f).isNotNull() for f in features})
    placed = marked.withColumn("_r", ranks).join(F.broadcast(axis.select("session", "session_idx")), "session")  # a calendar
    w = Window.partitionBy("key").orderBy("session_idx").rangeBetween(-(length - 1), Window.currentRow)
    held = placed.withColumn("_all", F.map_from_entries(F.collect_list(F.struct("session_idx", "_r")).over(w)))
    zero = F.array(*[F.lit(0.0)] * len(features))
    sequence = F.transform(F.sequence(F.col("session_idx") - length + 1, F.col("session_idx")), lambda i: F.coalesce(F.try_element_at("_all", i), zero))
    return held.select("session", "key", F.size("_all").cast("long").alias("present"), sequence.alias("sequence"))
