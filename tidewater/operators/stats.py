"""Statistics: rank correlation and AUC as window expressions; resampling by draws that spread over the cluster."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orderstats import order_statistics
from .ranks import average_rank


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """``by, n, ic``: rank correlation per group; null under three rows or without spread."""
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": average_rank(a, by), "_b": average_rank(b, by)})
    spread = (F.min("_a") < F.max("_a")) & (F.min("_b") < F.max("_b"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & spread, F.corr("_a", "_b")).alias("ic"))


def auc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """``by, n, auc`` by the rank-sum formula; null when one class is missing."""
    r = df.where(F.col(score).isNotNull()).withColumn("_r", average_rank(score, by))
    p = F.count_if(F.col(positive) == 1)
    n = F.count("*")
    value = (F.sum(F.when(F.col(positive) == 1, F.col("_r"))) - p * (p + 1) / 2) / (p * (n - p))
    return r.groupBy(*by).agg(n.alias("n"), F.when((p > 0) & (p < n), value).alias("auc"))


def classification(df: DataFrame, by: list[str], prob: str, y: str) -> DataFrame:
    """Accuracy, Brier score, precision and recall at one half, per group."""
    hit = F.col(prob) > 0.5
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((hit.cast("int") == F.col(y)).cast("double")).alias("accuracy"),
        F.avg(F.pow(F.col(prob) - F.col(y), 2)).alias("brier"),
        F.try_divide(F.count_if(hit & (F.col(y) == 1)), F.count_if(hit)).alias("precision"),
        F.try_divide(F.count_if(hit & (F.col(y) == 1)), F.count_if(F.col(y) == 1)).alias("recall"),
    )


def ridge(df: DataFrame, features: list[str], y: str, alpha: float) -> np.ndarray:
    """Weights of a ridge without intercept: Spark sums the cross products, the driver solves k equations."""
    k = len(features)
    cross = [F.sum(F.col(features[i]) * F.col(features[j])) for i in range(k) for j in range(i, k)]
    row = df.agg(*[c.alias(f"x{n}") for n, c in enumerate(cross)], *[F.sum(F.col(f) * F.col(y)).alias(f"y{n}") for n, f in enumerate(features)]).first()
    gram = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[at] or 0.0
            at += 1
    return np.linalg.solve(gram + alpha * np.eye(k), np.array([row[f"y{n}"] or 0.0 for n in range(k)]))


def winsorised(df: DataFrame, by: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The value cut to its group's two percentiles, exact; no task holds a group's values."""

    def bound(q: float, name: str) -> DataFrame:
        at = lambda n: (n - 1) * q
        # each bound by itself: what is ordered lies between the places that are asked for
        found = order_statistics(df, by, value, {"_a": lambda n: F.floor(at(n)), "_z": lambda n: F.ceil(at(n))})
        a, z, place = F.col("_a").cast("double"), F.col("_z").cast("double"), at(F.col("n"))
        between = (F.ceil(place) - place) * a + (place - F.floor(place)) * z
        return found.select(*by, F.when(a == z, a).otherwise(between).alias(name))

    known = df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by]))
    both = known.join(bound(low, "_low"), by, "left").join(bound(high, "_high"), by, "left")
    return both.withColumn(value, F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high"))).drop("_low", "_high")


def draw_number(*parts) -> Column:
    """A whole number below 2**52 that depends on the parts alone: the same on every executor and in every run."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def numbered(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``by, i, n, x``: a group's values that are not null, numbered from 0 in order."""
    w = Window.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull())
    return rows.select(*by, (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.count("*").over(w).alias("n"), F.col(value).cast("double").alias("x"))


def newey_west(df: DataFrame, by: list[str], order: str, value: str, lags: int = 5) -> DataFrame:
    """``by, n, nw_t``: t statistic of a group's mean with Bartlett weights; null under three values or without variance."""
    w = Window.partitionBy(*by)
    d = numbered(df, by, order, value).withColumn("d", F.col("x") - F.avg("x").over(w))
    d = d.withColumns({f"p{j}": F.col("d") * F.lag("d", j).over(w.orderBy("i")) for j in range(lags + 1)})
    variance = sum((F.coalesce(F.sum(f"p{j}"), F.lit(0.0)) * (1.0 if j == 0 else 2 * (1 - j / (lags + 1))) for j in range(lags + 1)), F.lit(0.0)) / F.count("*")
    n = F.count("*")
    return d.groupBy(*by).agg(n.alias("n"), F.when((n >= 3) & (variance > 0), F.avg("x") / F.sqrt(variance / n)).alias("nw_t"))


def _block_sums(df: DataFrame, by: list[str], order: str, value: str, block: int) -> DataFrame:
    """``by, start, length, n, total``: the sum of every run of ``block`` values and of as many as the last block of a draw takes."""
    rows = numbered(df, by, order, value).where(F.col("n") >= block)
    w = Window.partitionBy(*by).orderBy("i")
    rest = F.col("n") - (F.ceil(F.col("n") / block) - 1) * block
    upto = F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = rows.withColumns({"before": upto, "upto": whole, "rest": rest})
    ends = sums.select(*by, F.col("i").alias("last"), "upto")
    starts = sums.where(F.col("i") <= F.col("n") - block).select(*by, F.col("i").alias("start"), "n", "before", F.explode(F.array_distinct(F.array(F.lit(block).cast("long"), F.col("rest")))).alias("length"))
    return starts.withColumn("last", F.col("start") + F.col("length") - 1).join(ends, [*by, "last"]).select(*by, "start", "length", "n", (F.col("upto") - F.col("before")).alias("total"))


def _drawn_blocks(sums: DataFrame, by: list[str], draws: int, block: int, seed: int, whole: bool) -> DataFrame:
    """``by, draw, n, length, total`` of the blocks of every draw; the last one is cut to the group's length unless ``whole``."""
    groups = sums.groupBy(*by).agg(F.first("n").alias("n"))
    count = F.ceil(F.col("n") / block)
    each = groups.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    length = F.lit(block).cast("long") if whole else F.least(F.lit(block).cast("long"), F.col("n") - F.col("b") * block)
    each = each.select(*by, "draw", length.alias("length"), (draw_number(seed, *[F.col(c) for c in by], F.col("draw"), F.col("b")) % (F.col("n") - block + 1)).alias("start"))
    return each.join(sums, [*by, "start", "length"])


def block_bootstrap(df: DataFrame, by: list[str], order: str, value: str, draws: int, block: int, level: float, seed: int) -> DataFrame:
    """``by, low, high``: interval of a group's mean from means of moving blocks, drawn and added up over the cluster.

    A draw needs the sums of its blocks only, and those come from running sums: no group is
    gathered.  Groups shorter than a block have no row.
    """
    means = _drawn_blocks(_block_sums(df, by, order, value, block), by, draws, block, seed, False).groupBy(*by, "draw").agg((F.sum("total") / F.first("n")).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def studentized_interval(df: DataFrame, by: list[str], order: str, value: str, draws: int, block: int, level: float, seed: int) -> DataFrame:
    """``by, low, high``: interval of a group's mean by block means over their own standard error.

    The error of the series is that of all overlapping block means about its mean; a draw's is
    that of its block means about their mean, and the draw is centred at the mean of all
    block means.  A draw without spread counts as 0; a constant series gives its value twice.
    """
    sums = _block_sums(df, by, order, value, block).where(F.col("length") == block).withColumn("mean", F.col("total") / block)
    series = numbered(df, by, order, value).where(F.col("n") >= block).groupBy(*by).agg(F.avg("x").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    own = sums.join(series, by).groupBy(*by).agg(
        F.first("m").alias("m"), (F.first("lo") == F.first("hi")).alias("flat"), F.avg("mean").alias("centre"), F.sqrt(F.lit(block) / F.first("n") * F.avg(F.pow(F.col("mean") - F.col("m"), 2))).alias("s")
    )
    each = _drawn_blocks(sums, by, draws, block, seed, True).groupBy(*by, "draw").agg(F.avg("mean").alias("dm"), F.sqrt(F.var_pop("mean") / F.count("*")).alias("ds")).join(own, by)
    t = F.when(F.col("ds") > 1e-12, (F.col("dm") - F.col("centre")) / F.col("ds")).otherwise(0.0)
    tail = (1 - level) / 2
    cut = each.withColumn("t", t).groupBy(*by).agg(F.first("m").alias("m"), F.first("s").alias("s"), F.first("flat").alias("flat"), F.percentile("t", tail).alias("a"), F.percentile("t", 1 - tail).alias("b"))
    edge = lambda q: F.when(F.col("flat"), F.col("m")).otherwise(F.col("m") - F.col(q) * F.col("s"))
    return cut.select(*by, edge("b").alias("low"), edge("a").alias("high"))


def sign_flip_interval(df: DataFrame, by: list[str], order: str, value: str, draws: int = 10_000, level: float = 0.975, seed: int = 0) -> DataFrame:
    """``by, low, high``: the means that a two-sided sign-flip test at ``level`` does not reject.

    With signs s of a draw, A the mean of s * x and B that of s, the draw is as extreme as the
    data at a mean mu where |A - mu B| >= |m - mu|: between (m - A) / (1 - B) and
    (m + A) / (1 + B).  A mean is rejected when so few draws hold it, so the bounds are order statistics of the
    draws' ends.  A draw of equal signs holds every mean; if those alone suffice, or a group
    has one value, its bounds are null.
    """
    each = numbered(df, by, order, value).where("n >= 2").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    sign = F.when(draw_number(seed, *[F.col(c) for c in by], F.col("draw"), F.col("i")) % 2 == 0, 1).otherwise(-1)
    sums = each.withColumn("s", sign).groupBy(*by, "draw").agg(F.avg(F.col("s") * F.col("x")).alias("a"), F.sum("s").alias("b"), F.avg("x").alias("m"), F.first("n").alias("n"))
    ends = F.array_sort(F.array((F.col("m") - F.col("a")) / (1 - F.col("b") / F.col("n")), (F.col("m") + F.col("a")) / (1 + F.col("b") / F.col("n"))))
    held = sums.withColumn("e", F.when(F.abs("b") < F.col("n"), ends))
    # not rejected: 1 + draws that hold it > (1 - level) * (draws + 1)
    need = int((1 - level) * (draws + 1))
    w = Window.partitionBy(*by)
    low, high = F.col("e")[0], F.col("e")[1]
    ranked = held.withColumns({"r": F.row_number().over(w.orderBy(low.asc_nulls_first(), "draw")), "q": F.row_number().over(w.orderBy(high.desc_nulls_first(), "draw"))})
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("r") == max(need, 1), low)).alias("low"), F.max(F.when(F.col("q") == max(need, 1), high)).alias("high"))


def permutation_control(df: DataFrame, by: list[str], value: str, size: str, draws: int, seed: int) -> DataFrame:
    """``by, draw, mean``: means of random picks, as many as ``size`` says, from each group's rows.

    Draws spread over the cluster: each is a hash order of the rows, so a lost executor
    draws the same again.
    """
    many = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = Window.partitionBy(*by, "draw").orderBy(F.xxhash64(F.lit(seed), "draw", *df.columns))
    return many.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= F.col(size)).groupBy(*by, "draw").agg(F.avg(value).alias("mean"))
