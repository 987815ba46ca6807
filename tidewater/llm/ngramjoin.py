"""N-gram Jaccard join (operator 6) with adaptive multi-match prefixes.

All documents order their shingles alike, rare ones first.  Two sets of similarity t
share at least l of their first n - ceil(t * n) + l shingles, for every l.  Each
document picks the l of the lowest estimated cost and sends its prefix for that l: a
longer one meets more documents, but a partner has to share more of its shingles before
the two are compared.  Two documents that picked l and k need min(l, k) shared ones:
both prefixes hold those for the smaller of the two.

Equal sets are one class from the start.  Each class is first compared with one
other that shares much of its prefix; only classes that this leaves in different
components meet pair by pair, so a large group of near copies costs a link per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, broadcast, column, components, forget, scratch, short_batches, slices, stored, table
from .textkit import mix, window_hashes, windows_of, words_of

SHINGLE = 5
#: The similarity, in hundredths.
PERCENT = 75
#: The greatest l that a document may pick.
MATCHES = 3
#: Rounds in which each class meets one centre, before classes of different components meet pair by pair.
STAR_ROUNDS = 2
#: What comparing two documents costs, in rows of the prefix join.
COMPARISON = 50
#: Bits of a set's sketch, in longs, and how many rows a token has when its pairs are told apart by sketches before they are counted.
SKETCH, HEAVY = 8, 16
#: The frequency table has 2**20 counters whatever the corpus; it only orders shingles, so its errors change no result.
COUNTERS, PAGE = 1 << 20, 1 << 14


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a shorter text has one, an empty one none."""
    words = words_of(column, lower=True)
    hashes, at = windows_of(words, shingle)
    bounds = np.searchsorted(at, words.first)
    sets = []
    for d, n in enumerate(np.diff(words.first)):
        if n >= shingle:
            h = np.sort(hashes[bounds[d] : bounds[d + 1]])
            sets.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif n:
            sets.append(window_hashes(words.hashes, words.first[d : d + 1], n, int(n)))
        else:
            sets.append(hashes[:0])
    return sets


def _least_overlap(n: int, percent: int = PERCENT) -> int:
    """What a set of n shingles shares with any partner, at least."""
    return -(-percent * n // 100)


def prefix(hashes: np.ndarray, counts: np.ndarray, background: float, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """A set's prefix for the l of the lowest estimated cost, in order, and that l."""
    n, overlap = len(hashes), _least_overlap(len(hashes), percent)
    seen = counts[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
    most = min(MATCHES, overlap)
    first = n - overlap + 1
    order = np.lexsort((hashes, seen))[: first + most - 1]
    others = np.maximum(seen[order] - background, 1.0) - 1
    met = np.cumsum(others)[first - 1 :]
    ls = np.arange(1, most + 1)
    picked = int(np.argmin(met + first + ls + COMPARISON * met / ls)) + 1
    return hashes[order[: first + picked - 1]], picked


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """``64 * SKETCH`` bits of every set, a row of longs each: a bit says whether an odd number of the set's shingles fell on it.

    Two sets' sketches differ in no more bits than the sets do in shingles.
    """
    bits = 64 * SKETCH
    at = np.repeat(np.arange(len(sets)) * bits, [len(s) for s in sets])
    if len(at):
        at += (np.concatenate(sets) >> np.uint64(40)).astype(np.int64) % bits
    odd = (np.bincount(at, minlength=len(sets) * bits) & 1).astype(np.uint8).reshape(len(sets), bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _profile(rows: DataFrame, shingle: int) -> DataFrame:
    """One scan for two things: a row per document (doc_id, n, a, b, sketch) with its set's digest, and the counters' pages."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["doc_id", "n", "a", "b", "sketch", "part", "page", "counts"]
        doc_type = None
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), shingle)
            ids = batch.column("doc_id")
            doc_type = ids.type
            if sets:
                every = np.concatenate(sets)
                counts += np.bincount((every & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            # order-free digests: sums of two independent mixes
            a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            b = np.array([mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            none = pa.nulls(len(sets), pa.int32())
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(sketches(sets).reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), sketch, none, none, pa.nulls(len(sets), pa.binary())], names)
        if doc_type is not None:
            pages = counts.reshape(-1, PAGE)
            some = np.flatnonzero(pages.any(1))
            none = pa.nulls(len(some), pa.int64())
            part = pa.array(np.full(len(some), TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), doc_type), none, none, none, pa.nulls(len(some), pa.list_(pa.int64())), part, pa.array(some.astype(np.int32)), pa.array([pages[i].tobytes() for i in some], pa.binary())], names)

    return stored(rows.mapInArrow(run, f"doc_id {kind}, n long, a long, b long, sketch array<long>, part int, page int, counts binary"))


def _counters(profile: DataFrame, fan_in: int = 64) -> np.ndarray:
    """Add up the tasks' counters, ``fan_in`` at a time; the driver receives the fixed-size table."""

    def add(pdf):
        total = np.zeros(PAGE, np.uint64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.uint32)
        low = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pdf[["part", "page"]].iloc[:1].assign(counts=[low.tobytes()])

    pages = profile.where("page IS NOT NULL").select("part", "page", "counts")
    parts = (profile.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        pages = pages.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("page", "part").applyInPandas(add, "part int, page int, counts binary")
        parts = -(-parts // fan_in)
        if parts == 1:
            break
    counts = np.zeros(COUNTERS, np.float64)
    for _, page, raw in pages.toLocalIterator(prefetchPartitions=True):
        counts[page * PAGE : (page + 1) * PAGE] = np.frombuffer(raw, np.uint32)
    return counts


def _prefixes(rows: DataFrame, counters: Broadcast, wanted: Broadcast, hot: Broadcast | None, shingle: int, percent: int) -> DataFrame:
    """The prefix shingles of the wanted documents: without ``hot`` the bare tokens, with it those that may be shared.

    Rows then are (token, doc, n, pos, matches): the token's place in the document's order,
    and the document's l.
    """
    rows = rows.withColumn("key", F.xxhash64("doc_id"))
    schema = "token long" if hot is None else "token long, doc long, n int, pos int, matches int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counters.value
        background = float(np.median(counts))
        for batch in slices(batches, "text"):
            keep = np.flatnonzero(wanted.value.has(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            if not len(keep):
                continue
            batch = batch.take(pa.array(keep))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for doc, s in zip(ids, shingle_sets(batch.column("text"), shingle)):
                if len(s):
                    token, matches = prefix(s, counts, background, percent)
                    if hot is not None:
                        pos = np.flatnonzero(hot.value.has(token))
                        out.append((token[pos], np.full(len(pos), doc), *(np.full(len(pos), x, np.int32) for x in (len(s), 0, matches))))
                        out[-1][3][:] = pos
                    else:
                        out.append((token,))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                columns[0] = columns[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def verified(rows: DataFrame, pairs: DataFrame, repeated: bool, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (x, y), those whose sets reach the similarity: exact sizes of intersection and union."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc")).distinct()
    wanted = bitmap(ids.select(F.xxhash64("doc").alias("key")), "key")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            keep = np.flatnonzero(wanted.value.has(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            if len(keep):
                batch = batch.take(pa.array(keep))
                packed = [pack((t or "").encode()) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc", "z"])

    body = rows.withColumn("key", F.xxhash64("doc_id")).mapInArrow(texts, "doc long, z binary")
    body = stored(body.distinct() if repeated else body)
    both = pairs.join(body.select(F.col("doc").alias("x"), F.col("z").alias("zx")), "x").join(body.select(F.col("doc").alias("y"), F.col("z").alias("zy")), "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "zx", 1 << 18):
            left, right = (shingle_sets(pa.array([unpack(z).decode() for z in batch.column(c).to_pylist()], pa.string()), shingle) for c in ("zx", "zy"))
            good = []
            for i, (a, b) in enumerate(zip(left, right)):
                shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    good.append(i)
            if good:
                yield batch.select(["x", "y"]).take(pa.array(good))

    return both.select("x", "y", "zx", "zy").mapInArrow(compare, "x long, y long")


def _counts(n: str, pos: str, other_n: str, other_pos: str, matches: Column, percent: int) -> Column:
    """Whether a shared token counts: sizes allow the similarity, and both places the l-th match.

    A pair that shares ``need`` shingles has its l-th common one among the first
    n - need + l of each side.
    """
    need = F.ceil((F.col(n) + F.col(other_n)) * percent / (100 + percent))
    size = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent
    return size & (F.col(pos) < F.col(n) - need + matches) & (F.col(other_pos) < F.col(other_n) - need + matches)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    A document's set has the distinct shingles of ``shingle`` words of its whole text (A-Z folded,
    parted at ASCII white space); one of fewer words has all of them as one shingle; a
    null or blank text has none and is linked with nothing.  Two documents are linked
    when their sets' similarity is ``percent`` hundredths or more; ``component_id`` is the smallest id that
    links reach, the own included.

    Ids are integers; rows of one id count as one document per text; a row without id
    has no links but to equal sets.  An empty table gives no rows.  The driver holds the
    fixed-size counters and bitmaps only.
    """
    rows = short_batches(docs).select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    with scratch() as keep:
        return keep(stored(grouped(rows, shingle, percent)))


def placed_in(tokens: DataFrame, joined: DataFrame | None) -> DataFrame:
    """The tokens with their class's component: the class itself before any is known, or where it has no link."""
    if joined is None:
        return tokens.withColumn("comp", F.col("doc"))
    return tokens.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def _met(mixed: DataFrame, percent: int, sketched: bool = False) -> DataFrame:
    """The pairs (x, y) of different components that share a token, once for each token that counts, with the l that they need.

    ``sketched``: rows have a ``sketch``, and pairs go whose sketches differ in more bits than sets of the similarity do
    in shingles.  A group of near copies that are just too far apart shares its tokens among all its pairs.
    """
    cols = ["doc", "n", "pos", "matches", "comp", *["sketch"] * sketched]
    left = mixed.where("comp <> main").select("token", *[F.col(c).alias(f"l_{c}") for c in cols])
    right = mixed.select("token", (F.col("comp") == F.col("main")).alias("in_main"), *[F.col(c).alias(f"r_{c}") for c in cols])
    need = F.least("l_matches", "r_matches")
    on = (left["token"] == right["token"]) & (F.col("l_comp") != F.col("r_comp")) & (F.col("in_main") | (F.col("l_doc") < F.col("r_doc"))) & _counts("l_n", "l_pos", "r_n", "r_pos", need, percent)
    if sketched:
        apart = sum((F.bit_count(F.col("l_sketch")[i].bitwiseXOR(F.col("r_sketch")[i])) for i in range(SKETCH)), F.lit(0))
        both = F.col("l_n") + F.col("r_n")
        on &= apart <= both - 2 * F.ceil(both * percent / (100 + percent))
    return left.join(right, on).select(F.least("l_doc", "r_doc").alias("x"), F.greatest("l_doc", "r_doc").alias("y"), need.alias("need"))


def grouped(rows: DataFrame, shingle: int, percent: int, known: DataFrame | None = None, rounds: int = STAR_ROUNDS) -> DataFrame:
    """:func:`near_duplicates` of rows (doc_id, text) of bigint ids; ``known`` has links (x, y) that hold already, ``rounds`` is that of stars."""
    profile = _profile(rows, shingle)
    sets = profile.where("page IS NULL").select("doc_id", "n", "a", "b")
    classes = stored(profile.where("page IS NULL AND n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    reps = classes.where("rep IS NOT NULL").select("rep")
    counters = broadcast(rows.sparkSession, _counters(profile).astype(np.float32))
    wanted = bitmap(reps.select(F.xxhash64("rep").alias("key")), "key")
    seen = stored(_prefixes(rows, counters, wanted, None, shingle, percent).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    hot = bitmap(seen, "token")
    forget(seen)
    tokens = _prefixes(rows, counters, wanted, hot, shingle, percent)
    # rows that repeat an id would send their tokens again and again
    repeated = not sets.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    held = tokens = stored(tokens.distinct() if repeated else tokens)

    # star rounds: each class with the one that leads most of its prefix.  A copy's own edits come first in its order,
    # so the member that has a token earliest is the least edited one: the centre of a group of near copies.  From the
    # second round on the centres are those of a token's largest component (by all its members, so that one aggregation
    # by token does), for the classes that are not in it yet.
    # What a centre leads is a part of what the two share, so it is not held against l here: the pair is verified
    links = known
    joined = None if known is None else components(known.select(F.col("x").alias("a"), F.col("y").alias("b")))
    for _ in range(rounds):
        placed = placed_in(tokens, joined)
        place = [(-F.col("pos")).alias("pos"), F.bitwise_not("doc").alias("doc"), "n", "matches"]
        if joined is None:  # every class is a component of its own: the earliest of them leads
            leader = placed.groupBy("token").agg(F.max(F.struct(*place)).alias("m"), (F.min("doc") < F.max("doc")).alias("k"))
            xcomp = F.bitwise_not("m.doc")
        else:
            sizes = joined.groupBy("component").agg(F.count("*").alias("members"))
            sized = placed_in(tokens, joined.union(sizes.select("component", "component")).join(sizes, "component").select("node", "component", "members"))
            leader = sized.groupBy("token").agg(F.max(F.struct(F.coalesce("members", F.lit(0)).alias("size"), "comp", *place)).alias("m"), (F.min("comp") < F.max("comp")).alias("k"))
            xcomp = F.col("m.comp")
        leader = leader.where("k").select("token", xcomp.alias("xcomp"), F.bitwise_not("m.doc").alias("x"), F.col("m.n").alias("xn"), (-F.col("m.pos")).alias("xpos"), F.col("m.matches").alias("xmatches"))
        # components only grow, so a token of one component links nothing in later rounds either; nor does one of the filter's false hits
        led = stored(placed.join(leader, "token"))
        forget(held)
        held, tokens = led, led.select("token", "doc", "n", "pos", "matches")
        led = led.where((F.col("comp") != F.col("xcomp")) & _counts("n", "pos", "xn", "xpos", F.least("matches", "xmatches"), percent))
        star = led.groupBy("doc", "x").agg(F.count("*").alias("c")).groupBy("doc").agg(F.max_by("x", F.struct("c", -F.col("x"))).alias("x"))
        found = stored(verified(rows, stored(star.select("x", F.col("doc").alias("y"))), repeated, shingle, percent))
        links = found if links is None else links.union(found)
        joined = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    # last round: pairs of different components, of which one is not the token's largest
    placed = placed_in(tokens, joined)
    sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("c")).where("k > 1")
    mixed = stored(placed.join(stored(sizes.select("token", "main", (F.col("c") > HEAVY).alias("heavy"))), "token"))
    forget(held)
    heavy = mixed.where("heavy")
    if repeated or heavy.isEmpty():  # of repeated ids a row does not know its text's sketch
        met = _met(mixed, percent)
    else:
        met = _met(mixed.where("NOT heavy"), percent).union(_met(heavy.join(classes.select(F.col("rep").alias("doc"), "sketch"), "doc"), percent, True))
    pairs = met.groupBy("x", "y").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need")
    more = stored(verified(rows, stored(pairs.select("x", "y")), repeated, shingle, percent))
    joined = components(links.union(more).select(F.col("x").alias("a"), F.col("y").alias("b")))

    classes = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component_id"))
    return sets.join(classes, ["n", "a", "b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, unnest(s) AS t FROM sets),
rare AS (SELECT t FROM shingles GROUP BY t HAVING count(*) > 1),
kept AS (SELECT s.* FROM shingles s SEMI JOIN rare r ON s.t = r.t),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM kept a JOIN kept b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM r JOIN both_ways e ON e.x = r.y) SELECT x, min(y) AS y FROM r GROUP BY x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.y, s.doc_id)) AS component_id FROM sets s LEFT JOIN reach r ON r.x = s.doc_id
"""
