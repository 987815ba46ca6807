"""A corpus pipeline from raw documents to packed training sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import column, drop, scratch, shared_folder, stored, table
from tidewater.llm.decontaminate import clean
from tidewater.llm.langid import DIMENSIONS, UNDETERMINED, Profiles, fit, identify, score_floor
from tidewater.llm.lines import _flagged, dedup_lines
from tidewater.llm.ngramjoin import near_duplicates
from tidewater.llm.packing import added_tokens, pack

# In every stage: columns beside those of documents are carried along whatever their names; an empty table gives an empty one.


def _unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until no column has them."""
    taken = {c.lower() for c in docs.columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"{n}_" for n in names)
    return names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject the documents whose language cannot be told.

    Null texts and texts without a letter go, and texts that resemble no learned language:
    their score is under half of what all but a thousandth of the labelled texts reach.
    Without labelled rows every text with a letter stays.  Null ids and labels do not
    matter; repeated rows are judged alike.
    """
    # without labelled rows there is nothing to compare with: one empty prototype takes every text with a letter
    profiles = fit(docs)
    floor = score_floor(docs, profiles)
    profiles = profiles if profiles.languages else Profiles(["any"], np.zeros((1, DIMENSIONS), np.float32))
    pred, score = names = _unused(docs, "lang_pred", "score")
    found = identify(docs, profiles, carry=docs.columns, names=names)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= floor)).select(*[column(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that equal an earlier one, however short, or are within one edit; a document left without any text goes.

    ``n_chars`` follows the text.  A null or empty text stays as it is; rows without id come
    first; rows of one id are told apart by their texts, rows equal in both lose the same lines.
    """
    inner = _unused(docs, "removed_lines")[0]
    renamed = {c: f"{inner}_{i}" for i, c in enumerate(docs.columns) if c.lower() == "removed_lines"}
    docs_ = docs.select(*[column(c).alias(renamed.get(c, c)) for c in docs.columns])
    cut = dedup_lines(docs_).where((F.col("text") != "") | F.col("text").isNull() | (F.col("removed_lines") == 0))
    length = F.length("text").cast("long")
    return cut.select(*[length.alias(c) if c == "n_chars" else column(renamed.get(c, c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that of the smallest id, if any has one; of one id that of the smallest key.

    A row's key is a hash of all it holds, so different texts under one id (or none) are
    different documents, and rows that are equal throughout are one.  Null and blank texts
    are near to nothing.  Only rows that may go are moved.
    """
    values = [column(c) for c in docs.columns]
    key = F.xxhash64(*values, *[v.isNull() for v in values])
    narrow = docs.select(key.alias("key"), column("doc_id").alias("id"), column("text").alias("text"))
    with scratch() as keep:
        rows = near_duplicates(narrow, "key").groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("group"), F.count("*").alias("c"))
        ids = narrow.groupBy("key").agg(F.first("id").alias("id"))
        rows = stored(rows.join(ids, "key"))
        heads = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key")).alias("head"), F.count("*").alias("members"))
        others = rows.join(heads.where("members > 1"), "group").where("key <> head.key").select("key", F.lit(True).alias("goes"))
        moved = keep(stored(others.unionByName(rows.where("c > 1").join(others, "key", "left_anti").select("key", F.lit(False).alias("goes")))))
    whole = _flagged(docs.select(key.alias("key"), F.struct(*[v.alias(c) for v, c in zip(values, docs.columns)]).alias("doc")), moved.select("key"))
    fields = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    met = whole.where("_td_may").join(moved.where("goes").hint("merge"), "key", "left_anti").dropDuplicates(["key"])
    return whole.where("NOT _td_may").select(*fields).union(met.select(*fields))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that repeat a test item; null and empty texts repeat none, and a repeated row is judged like its like."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; a null text is a document of the end token alone, repeated rows are packed as they are."""
    return pack(docs, added=added_tokens())


STAGES = [
    ("language id", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Learned profiles and tokens have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each result written and read again."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:  # what the stage has stored goes once its result is written
            docs, done = keep(stored(stage(spark, docs, sf_dir))), docs
        if hasattr(done, "_stored_at"):
            drop(done)
    return STAGES[-1][1](spark, docs, sf_dir)
