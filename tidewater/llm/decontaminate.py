"""Benchmark decontamination (operator 8): rare n-gram seeds, then Smith-Waterman alignment.

A seed is two neighbouring words of a test item; a passage meets it where it has the two words
side by side or with one word between them.  From the alignment's costs follows how many
seeds a passage meets at least if its score reaches the threshold (:func:`least_seeds`): replaced,
dropped and inserted words each cost what the seeds they break are worth.  Of an item's
seeds the most common ones may therefore rest, one less than that number: whatever
reaches the threshold meets one of the others.  Where a document meets a rare seed, and as
many seeds as are needed in the room that an alignment can take, the passage around them
is aligned with the item word by word.  The score is the alignment's share of what a
verbatim copy would get, so edited and paraphrased copies score as far as they follow the item;
no pair that reaches the threshold is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast, column, scratch, short_batches, slices, stored, table
from .textkit import Words, mix, words_of

#: An item of fewer words has no seeds.
SHORTEST = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score, as a share of a verbatim copy's, from which a document counts as contaminated.
LEAST = 0.5
#: Words of test items that are broadcast at once; a larger benchmark takes several passes.
PART_WORDS = 2_000_000
#: Bits of the table that tells most words of a corpus from those that begin a seed.
FILTER_BITS = 20


@cache
def least_seeds(n: int, least: float) -> int:
    """How many of an item's n - 1 neighbouring pairs an alignment of at least that share meets, at least.

    With m words matched, at most 2m - s errors leave the score s.  Each break between two runs
    of matched item words takes an error and an unmatched item word; a pair inside a run
    is lost only to two inserted words.  (An error costs 1 whatever its kind.)
    """
    score = int(np.ceil(least * MATCH * n - 1e-9))
    fewest = n
    for m in range(-(-score // MATCH), n + 1):
        errors = MATCH * m - score
        runs = min(n - m, errors) + 1
        inside = m - runs
        fewest = min(fewest, inside - min(inside, (errors - runs + 1) // 2))
    return max(fewest, 0)


def room(n: int, least: float) -> int:
    """Words of a passage that an alignment of at least that share spans, at most."""
    return n + MATCH * n - int(np.ceil(least * MATCH * n - 1e-9))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash for two words in this order."""
    return mix(mix(first) + second * np.uint64(0x9E3779B97F4A7C15))


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score and the passage's (start, end)."""
    n = len(passage)
    steps = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        above = row[1:] + GAP
        value = np.concatenate([[0], np.maximum(diagonal, above)])
        source = np.concatenate([[0], np.where(diagonal >= above, origin[:-1], origin[1:])])
        fresh = value <= 0
        value[fresh], source[fresh] = 0, steps[fresh]
        # gaps in the item: the best earlier cell less one gap a step
        lifted = value - GAP * steps
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, steps, 0))
        row, origin = top + GAP * steps, source[at]
        k = int(np.argmax(row))
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), k)
    return best


class Items:
    """The words and seeds of a part of the benchmark."""

    def __init__(self, ids: list, column: pa.Array, least: float = LEAST):
        words = words_of(column, lower=True, marks=True)
        self.ids, self.words, self.first = ids, words.hashes, words.first
        self.size = np.diff(words.first)
        self.need = np.array([max(1, least_seeds(int(n), least)) for n in self.size], np.int64)
        self.room = np.array([room(int(n), least) for n in self.size], np.int64)
        item = words.doc_of()
        at = np.flatnonzero((item[1:] == item[:-1]) & (self.size[item[1:]] >= SHORTEST)) if len(item) else np.zeros(0, np.int64)
        h, at = pair_hashes(self.words[at], self.words[at + 1]), at
        # of three words the outer two may reach the threshold alone
        three = np.flatnonzero(self.size == 3)
        outer = self.first[three]
        h, at = np.concatenate([h, pair_hashes(self.words[outer], self.words[outer + 2])]), np.concatenate([at, outer])
        order = np.argsort(h, kind="stable")
        self.seeds, self.at = h[order], at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        self.rare = np.ones(len(h), bool)

    def rest(self, distinct: np.ndarray, counts: np.ndarray) -> None:
        """Let the most common seeds of each item rest, one less than an alignment meets at least."""
        df = np.zeros(len(self.seeds), np.int64)
        if len(distinct):
            at = np.minimum(np.searchsorted(distinct, self.seeds), len(distinct) - 1)
            df = np.where(distinct[at] == self.seeds, counts[at], 0)
        order = np.lexsort((self.seeds, -df, self.item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order])
        self.rare = rank >= self.need[self.item] - 1

    def tables(self) -> tuple[tuple, tuple]:
        """The rare seeds and all seeds: (bit table, hashes, places)."""
        return tuple((_bits(self.seeds[own]), self.seeds[own], np.flatnonzero(own)) for own in (self.rare, np.ones(len(self.seeds), bool)))


def _bits(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << FILTER_BITS, bool)
    table[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return table


def _met(words: Words, doc: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first word's place, seed) wherever a document has a seed's words side by side or with one between."""
    bits, hashes, places = table
    out = []
    for distance in (1, 2):
        if len(doc) <= distance:
            continue
        h = pair_hashes(words.hashes[:-distance], words.hashes[distance:])
        at = np.flatnonzero(bits[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        at = at[doc[at] == doc[at + distance]]
        a, b = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        n = b - a
        which = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        out.append((np.repeat(at, n), places[which.astype(np.int64)]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _parts(benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The test items, in parts of bounded size."""
    ids, texts, size = [], [], 0
    for key, text in benchmark.toLocalIterator():
        ids.append(key)
        texts.append(text or "")
        size += len(texts[-1]) // 2
        if size >= PART_WORDS:
            yield Items(ids, pa.array(texts, pa.string()), least)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, pa.array(texts, pa.string()), least)


def _seed_counts(docs: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each seed occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.unique(shared.value.seeds)
        table = _bits(seeds), seeds, np.arange(len(seeds))
        total = np.zeros(len(seeds), np.int64)
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), lower=True, marks=True)
            doc = words.doc_of()
            at, seed = _met(words, doc, table)
            once = np.unique(doc[at] * max(len(seeds), 1) + seed)
            total += np.bincount(once % max(len(seeds), 1), minlength=len(seeds))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seeds[met].view(np.int64)), pa.array(total[met])], ["seed", "n"])

    rows = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    seeds = np.array([r.seed for r in rows], np.int64).view(np.uint64)
    order = np.argsort(seeds)
    return seeds[order], np.array([r.n for r in rows], np.int64)[order]


def _matches(batch: pa.RecordBatch, items: Items, tables: tuple, least: float) -> dict[tuple[int, int], tuple]:
    """The best alignment (score, start, end, seeds) of each (row, item) of a batch that reaches ``least``."""
    words = words_of(batch.column("text"), lower=True, marks=True)
    doc = words.doc_of()
    pos, seed = _met(words, doc, tables[0])
    if not len(pos):
        return {}
    code = np.unique(doc[pos] * len(items.size) + items.item[seed])
    pos, seed = _met(words, doc, tables[1])
    own = doc[pos] * len(items.size) + items.item[seed]
    known = np.isin(own, code)
    own, pos, seed = own[known], pos[known], seed[known]
    # a word pair met at one place counts once, whatever number of the item's places has it
    order = np.lexsort((seed, pos, own))
    own, pos, seed = own[order], pos[order], seed[order]
    item = own % len(items.size)
    last = np.arange(len(own)) + items.need[item] - 1
    there = np.flatnonzero(last < len(own))
    there = there[(own[last[there]] == own[there]) & (pos[last[there]] - pos[there] <= items.room[item[there]])]
    best: dict[tuple[int, int], tuple] = {}
    if not len(there):
        return best
    # runs of such places, joined where their surroundings touch
    a, b = there, last[there]
    end = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = (own[a[1:]] != own[a[:-1]]) | (pos[a[1:]] - pos[end[:-1]] > items.room[item[a[1:]]])
    for x, y in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(a)]):
        d, i = divmod(int(own[a[x]]), len(items.size))
        n, reach = int(items.size[i]), int(items.room[i])
        lo = max(int(words.first[d]), int(pos[a[x]]) - reach)
        hi = min(int(words.first[d + 1]), int(pos[b[x:y].max()]) + reach + 1)
        score, start, stop = smith_waterman(items.words[items.first[i] : items.first[i + 1]], words.hashes[lo:hi])
        share = score / (MATCH * n)
        if share >= least and share > best.get((d, i), (0,))[0]:
            off = lo - int(words.first[d])
            inside = pos[a[x] : b[y - 1] + 1]
            best[d, i] = (share, off + start, off + stop, len(np.unique(inside[(inside >= lo + start) & (inside < lo + stop)])))
    return best


def _shared_parts(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, least: float) -> Iterator:
    """Broadcast each part of the benchmark with the seeds that are rare over all documents."""
    for items in _parts(benchmark.select(column(item_id), column(item_text)), least):
        items.rest(*_seed_counts(rows, broadcast(rows.sparkSession, items)))
        yield broadcast(rows.sparkSession, items)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document and test item that it repeats: ``doc_id, item_id, score, start, end, seeds``.

    ``score`` (0 to 1) is the best alignment's score over that of a verbatim copy; pairs
    below ``least`` are left out.  ``start`` and ``end`` are the passage's words (parted at
    ASCII white space and punctuation, A-Z folded); ``seeds`` counts the places in it that meet a seed.
    Of equally good alignments with one item the first counts.

    Null or empty texts match nothing, and an item of fewer than three words has no seed
    and takes no part.  A very long text is searched from end to end, a slice of the rows at a time.
    Ids may be null; repeated documents or items each give their rows; an empty table on
    either side gives no rows.  Other columns are ignored whatever their names.
    """
    rows = short_batches(docs).select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    kinds = (rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString())
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start long, end long, seeds long"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shared.value.tables()
            for batch in slices(batches, "text"):
                best = _matches(batch, shared.value, tables, least)
                found = sorted(best)
                if found:
                    columns = [batch.column("doc_id").take(pa.array([d for d, _ in found], pa.int64())), pa.array([shared.value.ids[i] for _, i in found])]
                    columns += [pa.array([best[k][j] for k in found], pa.float64() if j == 0 else pa.int64()) for j in range(4)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "start", "end", "seeds"])

        return rows.mapInArrow(run, schema)

    with scratch() as keep:
        found = [search(shared) for shared in _shared_parts(rows, benchmark, item_id, item_text, least)]
        return keep(stored(reduce(DataFrame.union, found))) if found else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The documents, with all their columns, that repeat no test item; rules as for :func:`contaminated`.

    Rows are judged where they are read: none moves.  The benchmark's parts are let go with the
    scratch around the call, if there is one.
    """
    rows = short_batches(docs).select(column(text).alias("text"))

    # Python is given names of our own: those of a table may have dots
    names, body = docs.columns, f"c{docs.columns.index(text)}"
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shared.value.tables()
            for batch in slices(batches, body):
                bad = {d for d, _ in _matches(pa.RecordBatch.from_arrays([batch.column(body)], ["text"]), shared.value, tables, least)}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)]))

        return run

    for shared in _shared_parts(rows, benchmark, item_id, item_text, least):
        docs = docs.mapInArrow(keep(shared), docs.schema)
    return docs.toDF(*names)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that repeats a test item, with the item and the alignment."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
