"""Pairs of rows that may have similar sets of words and are near in time.

All rows order their words alike, rare ones first.  Of two sets of similarity ``least`` each
has at least ceil(least * n) words in common with the other, so among the first
n - ceil(least * n) + k words of both at least k are shared: a pair that shares fewer needs
no look at its words.  Only hashes of those few words are shuffled; the order comes from a
table of fixed size, so a larger corpus makes it coarser but loses no pair.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

#: Cells of the table of frequencies, and how many of the rare words two rows have to share.
CELLS, SHARED = 1 << 18, 3
#: A slot of time is so many spans wide: rows near its end are laid out into the next one too.
SPANS = 4


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once, for what reads them several times."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def slots(at: Column, span: int) -> Column:
    """The slots of a row (``at`` and ``span`` in one unit): two rows at most a span apart have one in common."""
    return F.array_distinct(F.array(F.floor(at / (SPANS * span)), F.floor((at + span) / (SPANS * span))))


def _frequencies(items: DataFrame) -> np.ndarray:
    """How many rows have words of each cell."""
    laid = items.select(F.explode(F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit(CELLS - 1)))).alias("cell"))
    counted = laid.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # a row a cell
    table = np.zeros(CELLS, np.int64)
    table[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return table


def candidates(items: DataFrame, least: float, span: int) -> DataFrame:
    """``a_id, b_id`` (a_id < b_id), each once: no pair of the similarity ``least`` whose ``t`` differ by ``span`` or less is left out.

    ``items``: item_id, t (whole seconds), words (distinct; rows without words meet nothing).
    The pairs are stored, so joins with them know how few they are.
    """
    items = items.where(F.size("words") > 0)
    table = items.sparkSession.sparkContext.broadcast(_frequencies(items))

    @F.pandas_udf("array<long>")
    def rarest(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h, np.int64)
            out.append(h[np.lexsort((h, table.value[h & (CELLS - 1)]))][: len(h) - ceil(len(h) * least - 1e-9) + SHARED])
        return pd.Series(out)

    n = F.size("words")
    rows = items.select("item_id", "t", n.alias("n"), F.explode(slots(F.col("t"), span)).alias("_g"), rarest(F.transform("words", lambda w: F.xxhash64(w))).alias("_h"))
    # a key that stands for a word and a slot by chance brings pairs that are looked at in vain
    laid = rows.select(F.explode(F.transform("_h", lambda h: F.shiftrightunsigned(F.xxhash64(h, F.col("_g")), 20))).alias("_k"), "item_id", F.col("t").cast("long").alias("t"), "n")
    a, b = (laid.select("_k", *[F.col(c).alias(f"{p}_{c}") for c in ("item_id", "t", "n")]) for p in "ab")
    needed = lambda m: F.ceil(m * F.lit(least) - 1e-9)
    # merged, not broadcast: the planner takes the exploded keys for no more than what they come from
    near = (F.col("a_item_id") < F.col("b_item_id")) & (F.abs(F.col("a_t") - F.col("b_t")) <= span) & (F.least("a_n", "b_n") >= needed(F.greatest("a_n", "b_n")))
    met = a.join(b.hint("merge"), "_k").where(near).groupBy("a_item_id", "b_item_id").agg(F.count("*").alias("_shared"), F.least(F.lit(SHARED), needed(F.first(F.greatest("a_n", "b_n")))).alias("_least"))
    return stored(met.where(F.col("_shared") >= F.col("_least")).select(F.col("a_item_id").alias("a_id"), F.col("b_item_id").alias("b_id")), "alike")


def of_pairs(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """The items that are in a pair, stored: most are in none, and their words stay where they are."""
    ids = pairs.select(F.explode(F.array("a_id", "b_id")).alias("item_id")).distinct()
    return stored(items.join(ids, "item_id", "left_semi"), "alike-items")
