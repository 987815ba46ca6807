"""Language identification (operator 10) with hyperdimensional profiles.

Each letter has a random +1/-1 vector.  A trigram is bound from its letters' vectors,
permuted (rolled) by their place; a document bundles (adds) its trigrams' vectors, a
language's prototype bundles those of its labelled documents, and a document gets the
language whose prototype has the greatest cosine with it.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, short_batches, slices, table

DIMENSIONS = 1024
SEED = 20240229
#: Letters share this many vectors (by code point); a trigram id has 10 bits a letter.
_CODES = 1024
#: Trigram vectors that a worker keeps (64 MiB); further ones are bound again when met.
_KEPT = 1 << 16
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Code of every code point: 0 for what is no letter, else 1 to 1023 by its lower case.

    Combining marks have codes too, for they tell languages apart, but are no letters:
    see :func:`is_letter`.
    """
    if not _LETTERS:
        codes = np.zeros(sys.maxunicode + 1, np.uint16)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                codes[cp] = 1 + ord(low[0]) % (_CODES - 1)
            elif unicodedata.combining(c):
                codes[cp] = 1 + cp % (_CODES - 1)
        _LETTERS.append(codes)
    return _LETTERS[0]


_ALPHABET: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter (``str.isalpha``)."""
    if not _ALPHABET:
        _ALPHABET.append(np.fromiter((chr(cp).isalpha() for cp in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _ALPHABET[0]


class Trigrams:
    """Trigram vectors, bound on demand and kept up to a bound."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (_CODES, dimensions), np.int8) * 2 - 1
        self.places = (np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters)
        self.ids, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kept = np.zeros((1024, dimensions), np.int8)

    def bind(self, ids: np.ndarray) -> np.ndarray:
        a, b, c = self.places
        return a[ids >> 20] * b[(ids >> 10) & 1023] * c[ids & 1023]

    def learn(self, ids: np.ndarray) -> None:
        """Keep the vectors of (sorted, distinct) ids as far as the bound goes."""
        new = np.setdiff1d(ids, self.ids, assume_unique=True)[: _KEPT - len(self.ids)]
        if len(new):
            n = len(self.ids)
            while len(self.kept) < n + len(new):
                self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
            self.kept[n : n + len(new)] = self.bind(new)
            order = np.argsort(merged := np.concatenate([self.ids, new]))
            self.ids, self.rows = merged[order], np.concatenate([self.rows, np.arange(n, n + len(new))])[order]

    def bundle(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the ids' vectors, each as often as it occurs."""
        at = np.searchsorted(self.ids, ids)
        at[at == len(self.ids)] = 0
        known = self.ids[at] == ids if len(self.ids) else np.zeros(len(ids), bool)
        total = counts[known].astype(np.float32) @ self.kept[self.rows[at[known]]].astype(np.float32)
        if not known.all():
            for part in np.array_split(np.flatnonzero(~known), 1 + len(ids) // 4096):
                total = total + counts[part].astype(np.float32) @ self.bind(ids[part]).astype(np.float32)
        return total


def trigrams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of a list of texts, sorted, and which texts have a letter.

    Everything between letters counts as one gap, and so do a text's ends; case is folded.
    """
    joined = [(t or "") for t in texts]
    sizes = np.array([len(t) + 1 for t in joined])
    cps = np.frombuffer("".join(t + "\0" for t in joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letter_codes()[cps].astype(np.int64)
    which = np.repeat(np.arange(len(texts)), sizes)
    start = np.zeros(len(codes), bool)
    start[np.cumsum(sizes)[:-1]] = True
    start[:1] = True
    gap = codes == 0
    double = gap & np.concatenate([[False], gap[:-1]]) & ~start
    lettered = np.bincount(which[is_letter()[cps]], minlength=len(texts)) > 0
    codes, which, gap = codes[~double], which[~double], gap[~double]
    # a gap before the first letter comes from the text before, whose end is a gap
    codes = np.concatenate([[0], codes, [0]])
    ids = (codes[:-2] << 20) | (codes[1:-1] << 10) | codes[2:]
    # centred trigrams: a letter with what stands before and behind it
    keep = ~gap
    nxt = np.concatenate([which[1:], which[-1:]])
    ids = np.where(nxt != which, ids & ~1023, ids)
    key = (which[keep] << 30) | ids[keep]
    key, counts = np.unique(key, return_counts=True)
    return key >> 30, key & ((1 << 30) - 1), counts, lettered


@dataclass
class Profiles:
    """Prototypes of the languages, one unit vector each."""

    languages: list[str]
    vectors: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 5000) -> Profiles:
    """Learn prototypes from labelled documents that are not held out.

    About ``per_language`` documents of each language are taken (all, if fewer), chosen
    by a hash of id and text; their whole texts are bundled in the tasks, and the driver
    receives one vector per language.
    """
    rows = short_batches(docs).select(column(doc_id).alias("doc_id"), column(text).alias("text"), column(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(counts), "lang").where(chance < F.col("share")).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: dict[str, np.ndarray] = {}
        grams = Trigrams()
        for batch in slices(batches, "text"):
            names = np.array(batch.column("lang").to_pylist(), object)
            which, ids, n, _ = trigrams_of(batch.column("text").to_pylist())
            for name in set(names):
                own = names[which] == name
                gram, back = np.unique(ids[own], return_inverse=True)
                grams.learn(gram)
                vectors[name] = vectors.get(name, 0) + grams.bundle(gram, np.bincount(back, n[own], len(gram))).astype(np.float64)
        out = [(k, v) for k, v in vectors.items() if np.ndim(v)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["lang", "v"])

    parts = sample.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).orderBy("lang", "i").collect()
    languages = sorted({r.lang for r in sums})
    vectors = np.array([r.x for r in sums]).reshape(len(languages), -1) if sums else np.zeros((0, DIMENSIONS))
    return Profiles(languages, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document (after the columns of ``carry`` in place of the id, if given).

    ``score`` is the greatest cosine, cut to 0..1; of equal ones the language first in
    the alphabet wins.  A text that is null, empty or without letters, or any text when
    nothing was learned, is ``und`` with score 0.  Ids may be null or repeat; an empty
    table gives no rows.  ``names`` are those of the two new columns; a carried column
    of such a name (in any case) is refused.
    """
    if carry and {n.lower() for n in names} & {c.lower() for c in carry}:
        raise ValueError(f"the columns {names} cannot be carried")
    # Python is given names of our own: those of a table may have dots
    taken = [column(doc_id)] if carry is None else [column(c) for c in carry]
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(taken)], column(text).alias("text"))
    kept = [f"c{i}" for i in range(len(taken))]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), "pred string", "score double"])
    languages, known = profiles.languages, profiles.vectors

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams()
        for batch in slices(batches, "text"):
            which, ids, n, lettered = trigrams_of(batch.column("text").to_pylist())
            grams.learn(np.unique(ids))
            bounds = np.searchsorted(which, np.arange(batch.num_rows + 1))
            pred, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if languages:
                for d in np.flatnonzero(lettered):
                    v = grams.bundle(ids[bounds[d] : bounds[d + 1]], n[bounds[d] : bounds[d + 1]])
                    cosines = known @ v / max(float(np.linalg.norm(v)), 1e-9)
                    best = int(np.argmax(cosines))
                    pred[d], score[d] = languages[best], min(max(float(cosines[best]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score)], [*kept, "pred", "score"])

    return rows.mapInArrow(predict, schema).toDF(*(["doc_id"] if carry is None else carry), *names)


def score_floor(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", share: float = 0.001, of_it: float = 0.5) -> float:
    """A score under which a text resembles no learned language: ``of_it`` times the score that all but ``share`` of the labelled texts reach.

    Every labelled text is scored; without labelled texts the floor is 0.
    """
    labelled = docs.select(column(text).alias("text"), column(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if not profiles.languages:
        return 0.0
    scored = identify(labelled, profiles, doc_id="lang").where(F.col("lang_pred") != UNDETERMINED)
    return of_it * (scored.agg(F.percentile_approx("score", F.lit(share), F.lit(10000))).first()[0] or 0.0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
