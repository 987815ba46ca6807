"""Near-duplicate detection with SuperMinHash signatures (operator 13).

Every shingle of a document draws a random permutation of the signature's positions, one
position a step, and bids ``step + fraction`` for it; a position keeps the lowest bid.  The
ranks of one element are all different, so a signature varies less than one of independent
minima.  A document stops once all its positions are below the next step: no later bid can
win, so a long document takes a step or two and only very short ones take them all.

Positions agree with the probability of the sets' similarity.  Bands of them are tokens;
documents of one token are candidates, which are compared on their full sets; what holds is
grouped by the distributed union-find of :func:`components`.

Equal sets are one class from the start.  A class first meets one centre, the candidate that
shares most tokens with others.  Documents of bands that this leaves with several components go
through the n-gram join of :mod:`ngramjoin`: similar ones that are just no links share bands as
often as links do, and only their rare shingles tell them apart without comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, column, components, forget, scratch, short_batches, slices, stored, table
from .ngramjoin import grouped, placed_in, shingle_sets, verified
from .textkit import mix

SHINGLE, PERCENT = 4, 80
#: Bands times positions a band.  Of pairs at the similarity itself, five in a hundred million share no band: 0.59 ** 32.
BANDS, ROWS = 32, 4
#: Rounds in which each class meets one centre of its bands, and of its rare shingles after that.
STAR_ROUNDS, RARE_ROUNDS = 2, 4
#: A bid that no element has made.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], positions: int) -> np.ndarray:
    """The signature of every set, a row each: per position the lowest ``step << 32 | fraction`` of its elements.

    The elements of all sets take a step together; a set leaves once all its positions are
    filled, as bids only rise from step to step.
    """
    m = positions
    sizes = np.array([len(s) for s in sets], np.int64)
    best = np.full((len(sets), m), _NONE)
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if len(owner) else np.zeros(0, np.uint64)
    order = None  # of each element that is left, its permutation as far as it is drawn
    for step in range(m):
        if not len(owner):
            break
        drawn = mix(element + np.uint64(((step + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        other = step + ((drawn >> np.uint64(32)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
        if order is None:
            at = other
        else:
            rows = np.arange(len(owner))
            at = order[rows, other].astype(np.int64)
            order[rows, other] = order[:, step]
        bid = np.uint64(step << 32) | (drawn & np.uint64(0xFFFFFFFF))
        np.minimum.at(best.reshape(-1), owner * m + at, bid)
        open_sets = (best == _NONE).any(1)
        left = open_sets[owner]
        if order is None and left.any():  # most sets leave before a second step, so permutations are laid out only now
            order = np.tile(np.arange(m, dtype=np.uint16), (int(left.sum()), 1))
            order[np.arange(len(order)), other[left]] = 0
        elif order is not None:
            order = order[left]
        owner, element = owner[left], element[left]
    return best


def band_tokens(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit token per band of each signature; bands of different places never share one but by chance."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), np.uint64(((b + 1) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = h
    return out


def _profile(rows: DataFrame, bands: int, per_band: int, shingle: int) -> DataFrame:
    """One scan: a row per document with its set's size, two digests of it and its tokens."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), shingle)
            # order-free digests: sums of two independent mixes
            a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            b = np.array([mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            tokens = band_tokens(signatures(sets, bands * per_band), bands, per_band).view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(tokens.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), flat], ["doc_id", "n", "a", "b", "tokens"])

    return stored(rows.mapInArrow(run, f"doc_id {kind}, n long, a long, b long, tokens array<long>"))


def _texts(source: DataFrame, wanted: Broadcast, repeated: bool) -> DataFrame:
    """The rows whose ids may be wanted, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(wanted.value.has(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            if len(keep):
                yield batch.select(["doc_id", "text"]).take(pa.array(keep))

    found = source.withColumn("key", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, text string")
    return found.dropDuplicates(["doc_id", "text"]) if repeated else found


def minhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    A document's set has the distinct shingles of ``shingle`` words of its whole text (A-Z
    folded, parted at ASCII white space); one of fewer words has all of them as one shingle;
    a null or blank text has none and is linked with nothing.  Two documents are linked when
    their sets' similarity is ``percent`` hundredths or more, which is decided on the full
    sets; ``component_id`` is the smallest id that links reach, the own included, and
    ``kept`` says whether it is the own.  Candidates are pairs with an equal band.

    Ids are integers; rows of one id count as one document per text and repeated rows are
    answered alike; a row without id has no links but to equal sets, and is kept if no equal
    set has an id.  Very long texts are one document each; a task holds the shingles of one.
    Other columns are ignored whatever their names; an empty table gives no rows.
    """
    source = short_batches(docs).select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    with scratch() as keep:
        return keep(stored(_groups(source, shingle, percent, bands, rows)))


def _groups(source: DataFrame, shingle: int, percent: int, bands: int, per_band: int) -> DataFrame:
    profile = _profile(source, bands, per_band, shingle)
    sets = profile.select("doc_id", "n", "a", "b")
    # equal sets have equal tokens
    classes = stored(profile.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")))
    repeated = not sets.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    single = classes.where("rep IS NOT NULL").select(F.col("rep").alias("doc"), F.col("n").cast("int").alias("n"), F.explode("tokens").alias("token"))
    shared = stored(single.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    tokens = single.join(shared, "token")
    weight = tokens.groupBy("doc").agg(F.sum("c").alias("weight"))
    tokens = stored(tokens.select("token", "doc", "n").join(weight, "doc"))
    forget(shared)
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    links = joined = None
    for _ in range(STAR_ROUNDS):
        placed = placed_in(tokens, joined)
        centre = F.max(F.struct("weight", F.col("doc"), "n"))
        most = placed.groupBy("token", "comp").agg(F.count("*").alias("c"), centre.alias("l")).groupBy("token")
        # at first every class is a component of its own: the one that shares most leads
        rank = F.struct("c", "comp") if joined is not None else F.col("l")
        leader = most.agg(F.max_by(F.struct("comp", "l"), rank).alias("m"), F.count("*").alias("k")).where("k > 1")
        led = placed.join(leader.select("token", F.col("m.comp").alias("xcomp"), F.col("m.l.doc").alias("x"), F.col("m.l.n").alias("xn")), "token")
        led = led.where((F.col("comp") != F.col("xcomp")) & near("n", "xn"))
        star = led.groupBy("doc", "x").agg(F.count("*").alias("c")).groupBy("doc").agg(F.max_by("x", F.struct("c", -F.col("x"))).alias("x"))
        found = stored(verified(source, stored(star.select("x", F.col("doc").alias("y"))), repeated, shingle, percent))
        links = found if links is None else links.union(found)
        joined = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    # bands that still hold several components: their documents meet by rare shingles.  Bands cannot tell a group of copies
    # that are just too far apart from one of links, so pairs of a band would be all pairs of such a group
    placed = placed_in(tokens, joined)
    several = placed.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("token")
    open_docs = stored(placed.join(several, "token", "left_semi").select("doc").distinct())
    forget(tokens)
    wanted = bitmap(open_docs.select(F.xxhash64("doc").alias("key")), "key")
    left = stored(_texts(source, wanted, repeated).join(open_docs.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi"))
    met = grouped(left, shingle, percent, links, RARE_ROUNDS).where("doc_id <> component_id")
    joined = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(met.select(F.col("component_id"), F.col("doc_id"))))

    classes = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component_id"))
    found = sets.join(classes, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it stays, of every document."""
    return minhash_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, unnest(s) AS t FROM sets),
rare AS (SELECT t FROM shingles GROUP BY t HAVING count(*) > 1),
kept AS (SELECT s.* FROM shingles s SEMI JOIN rare r ON s.t = r.t),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM kept a JOIN kept b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM r JOIN both_ways e ON e.x = r.y) SELECT x, min(y) AS y FROM r GROUP BY x
), grouped AS (
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.y, s.doc_id)) AS component_id FROM sets s LEFT JOIN reach r ON r.x = s.doc_id
)
SELECT *, doc_id = component_id AS kept FROM grouped
"""
