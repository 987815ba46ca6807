"""Substring dedup (operator 5): every word run of a given length that occurs earlier in the corpus goes.

The reference of each document is the corpus before it.  An automaton of that grows with
the corpus, so it can neither be broadcast under a bound nor met by every document;
matching statistics are found by content instead (README.md, "Substring dedup"):

* The minimizer of a window of words picks an anchor, a short word run that every
  copy of the window picks too.  Windows in a row with one anchor are a piece.
* Anchors that occur once cannot lie in a repeat.  For the others, pieces of equal
  content are grouped: all windows but those of a group's first piece are repeats.
* Where an anchor has several contents (a repeat begins or ends there), the windows
  of the contents' first pieces are grouped one by one.

All grouping is by hash with map-side combination; nothing gathers a group's members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, column, scratch, short_batches, slices, stored, table
from .textkit import Words, _range_hash, _WORD_BASE, mix, window_hashes, words_of

WINDOW = 20
#: Words of an anchor.
ANCHOR = 8


class Pieces:
    """The pieces of a batch: window starts ``first`` to ``last`` share the anchor at word ``at``."""

    def __init__(self, words: Words, window: int, anchor: int):
        n = np.maximum(np.diff(words.first) - window + 1, 0)
        starts = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc = np.repeat(np.arange(len(n)), n)
        grams = window_hashes(words.hashes, np.arange(max(len(words.hashes) - anchor + 1, 0)), anchor, 1)
        # leftmost smallest gram of each window, by doubling the width looked at
        width, need, best = 1, window - anchor + 1, np.arange(len(grams))
        while width < need:
            step = min(width, need - width)
            right = best[np.minimum(np.arange(len(grams)) + step, max(len(grams) - 1, 0))]
            best = np.where(grams[right] < grams[best], right, best)
            width += step
        at = best[starts]
        cut = np.ones(len(starts), bool)
        cut[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        cut = np.flatnonzero(cut)
        self.doc, self.first, self.at = doc[cut], starts[cut], at[cut]
        self.count = np.diff(np.concatenate([cut, [len(starts)]]))
        self.anchor = grams[self.at]
        self.window = window

    def content(self, words: Words) -> np.ndarray:
        """A hash of the words of each piece."""
        end = self.first + self.count - 1 + self.window
        return mix(_range_hash(words.hashes, self.first, end, _WORD_BASE) + self.count.astype(np.uint64))

    def select(self, keep: np.ndarray) -> Pieces:
        part = object.__new__(Pieces)
        part.window = self.window
        for name in ("doc", "first", "at", "count", "anchor"):
            setattr(part, name, getattr(self, name)[keep])
        return part


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _place(content: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One hash for a piece's content and where it stands."""
    return mix(content ^ mix(key.view(np.uint64) + start.astype(np.uint64)))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, version, start, count``: runs of window starts whose windows occur earlier (docs: doc_id, text, version)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "version"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([_signed(Pieces(words_of(batch.column("text")), window, anchor).anchor)], ["anchor"])

    seen = docs.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("c"))
    hot = bitmap(seen.where("c > 1"), "anchor")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            p = Pieces(words, window, anchor)
            p = p.select(hot.value.has(p.anchor))
            which = pa.array(p.doc)
            columns = [batch.column("doc_id").take(which), batch.column("version").take(which), pa.array((p.first - words.first[p.doc]).astype(np.int32)), pa.array(p.count.astype(np.int32)), _signed(p.content(words)), _signed(p.anchor)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "start", "count", "content", "anchor"])

    found = stored(docs.select("doc_id", "version", "text").mapInArrow(pieces, f"doc_id {kind}, version long, start int, count int, content long, anchor long"))
    groups = stored(found.groupBy("content").agg(F.min(F.struct("doc_id", "version", "start")).alias("head"), F.count("*").alias("c"), F.min("anchor").alias("anchor")))
    later = (
        found.join(groups.where("c > 1").select("content", "head"), "content")
        .where(F.struct("doc_id", "version", "start") > F.col("head"))
        .select("doc_id", "version", "start", "count")
    )
    several = groups.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    heads = groups.join(several, "anchor", "left_semi").select("content", "head.*")
    # the same arithmetic as _place, on the rows that stand for their contents
    border = bitmap(_place_column(heads), "place")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            p = Pieces(words, window, anchor)
            p = p.select(hot.value.has(p.anchor))
            key = batch.column("key").to_numpy(zero_copy_only=False)
            p = p.select(border.value.has(_place(p.content(words), key[p.doc], p.first - words.first[p.doc])))
            at = np.repeat(p.first - np.concatenate([[0], np.cumsum(p.count)[:-1]]), p.count) + np.arange(p.count.sum())
            doc = np.repeat(p.doc, p.count)
            which = pa.array(doc)
            columns = [batch.column("doc_id").take(which), batch.column("version").take(which), pa.array((at - words.first[doc]).astype(np.int32)), _signed(window_hashes(words.hashes, at, window))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "start", "window"])

    single = stored(keyed.select("doc_id", "version", "key", "text").mapInArrow(windows, f"doc_id {kind}, version long, start int, window long"))
    heads = single.groupBy("window").agg(F.min(F.struct("doc_id", "version", "start")).alias("head"), F.count("*").alias("c")).where("c > 1")
    inner = single.join(heads, "window").where(F.struct("doc_id", "version", "start") > F.col("head")).select("doc_id", "version", "start", F.lit(1).alias("count"))
    return later.union(inner)


def _place_column(heads: DataFrame) -> DataFrame:
    """``place`` of each row (content, doc_id, version, start), computed in the tasks by :func:`_place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, key, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("content", "key", "start"))
            yield pa.RecordBatch.from_arrays([_signed(_place(content.astype(np.int64).view(np.uint64), key.astype(np.int64), start))], ["place"])

    return heads.select("content", F.xxhash64("doc_id", "version").alias("key"), "start").mapInArrow(run, "place long")


def kept_text(words: Words, removed: np.ndarray) -> pa.Array:
    """Every document's kept words, joined by one space."""
    kept = np.flatnonzero(~removed)
    doc = words.doc_of()[kept]
    size = (words.ends - words.starts)[kept]
    space = np.zeros(len(kept), bool)
    space[:-1] = doc[1:] == doc[:-1]
    length = size + space
    begin = np.cumsum(length) - length
    total = int(length.sum())
    source = np.repeat(words.starts[kept] - begin, length) + np.arange(total)
    out = np.append(words.data, np.uint8(0x20))[np.minimum(source, len(words.data))]
    out[(begin + size)[space]] = 0x20
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, length, len(words.first) - 1))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(words.first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, kept, n_words, n_removed`` of every document.

    Words are parted at ASCII white space.  Every word goes that lies in a window of
    ``window`` words whose sequence also starts earlier: in a document of smaller id, or
    further up in the same document.  Windows are judged on the input.  ``kept`` has the
    other words, joined by one space.

    A null text has no words.  Rows of equal id and text are one document (all of them
    keep or lose the same words); texts that differ under one id are told apart and
    ordered by their checksum; a null id comes before all others.  An empty table gives
    no rows; other columns are ignored whatever their names.  A very long text is one
    document like any other: a task holds one at a time.  Windows are compared by 64-bit hashes.
    """
    body = column(text)
    rows = short_batches(docs).select(column(doc_id).alias("doc_id"), body.alias("text"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("version"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with scratch() as keep:
        spans = keep(stored(repeats(rows, window, anchor).distinct().groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "count")).alias("spans"))))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            z = [pack((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(z, pa.binary())], ["doc_id", "version", "z"])

    packed = rows.mapInArrow(squeeze, f"doc_id {kind}, version long, z binary")
    both = packed.join(spans, packed["doc_id"].eqNullSafe(spans["doc_id"]) & (packed["version"] == spans["version"]), "left").select(packed["doc_id"], "z", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "z", 1 << 18):
            words = words_of(pa.array([unpack(z) for z in batch.column("z").to_pylist()], pa.large_binary()).cast(pa.large_string()))
            spans = batch.column("spans")
            change = np.zeros(len(words.starts) + 1, np.int64)
            flat = spans.flatten()
            if len(flat):
                doc = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))
                start = words.first[doc] + flat.field("start").to_numpy()
                np.add.at(change, start, 1)
                np.add.at(change, start + flat.field("count").to_numpy() - 1 + window, -1)
            removed = np.cumsum(change[:-1]) > 0
            n = np.diff(words.first)
            lost = np.bincount(words.doc_of()[removed], minlength=len(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), kept_text(words, removed).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(lost.astype(np.int64))], ["doc_id", "kept", "n_words", "n_removed"])

    return both.mapInArrow(cut, f"doc_id {kind}, kept string, n_words long, n_removed long")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when repeated runs of twenty words go."""
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), heads AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM windows
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM heads, (SELECT unnest(range(0, 20)) AS j) WHERE r > 1
), each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
