"""Sharding (operator 3): a permutation-filled lookup table gives every key its shard in constant time.

The shards take turns; at its turn a shard claims the next free slot of its own
pseudo-random permutation of a prime-sized table.  Slots come out even to one per
shard, and when a shard goes, few keys besides its own move.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A prime; at 100 or more slots a shard, loads differ by 1 % at most.
SLOTS = 65_537
SHARDS = 64


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot.  ``slots`` is a prime above the number of shards."""
    if not shards:
        raise ValueError("there has to be a shard")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names have to differ")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots has to be a prime not below the number of shards")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "little") % slots for d in digests]
    step = [int.from_bytes(d[8:], "little") % (slots - 1) + 1 for d in digests]
    owner = [-1] * slots
    left = slots
    while left:
        for shard in range(len(shards)):
            if not left:
                break
            at = place[shard]
            while owner[at] >= 0:
                at = (at + step[shard]) % slots
            owner[at] = shard
            place[shard] = (at + step[shard]) % slots
            left -= 1
    return np.array(owner)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the first 32 bits of the md5 of its text, modulo the table's size (a null key counts as '')."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, shard_column: str = "shard", slot_column: str = "slot") -> DataFrame:
    """Add each row's slot and shard name.

    The table of ``slots`` rows, fixed whatever the data, is broadcast; rows are not
    moved.  Equal keys share a shard, repeated rows stay, an empty table stays empty.  A
    column that already has one of the two new names is refused.
    """
    if clash := {shard_column, slot_column} & set(rows.columns):
        raise ValueError(f"the rows already have {sorted(clash)}")
    owner = lookup_table(shards, slots)
    lookup = rows.sparkSession.createDataFrame(list(zip(range(slots), (shards[i] for i in owner))), f"`{slot_column}` int, `{shard_column}` string")
    return rows.withColumn(slot_column, slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(lookup), slot_column).select(*[f"`{c}`" for c in rows.columns], f"`{slot_column}`", f"`{shard_column}`")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 4, shard_column: str = "shard") -> None:
    """Write a Parquet folder per shard; a salt spreads each shard over several tasks."""
    salt = F.floor(F.rand(7) * files_per_shard)
    placed.repartition(F.col(f"`{shard_column}`"), salt).write.partitionBy(shard_column).parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    names = [f"shard-{i:03d}" for i in range(SHARDS)]
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", names)
