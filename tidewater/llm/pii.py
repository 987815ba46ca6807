"""Personal data (operator 9): fixed patterns, and a skip-chain CRF that adds what resembles them.

Nodes of the model are the words that hold a digit or an ``@``.  Neighbouring nodes are
joined by chain potentials, distant nodes of equal letters and digits (or of the same
long run of digits) by skip potentials; loopy sum-product messages carry the labels of
pattern matches to them, so that one document labels an entity alike throughout.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, short_batches, slices, table
from .textkit import _LOWER, _range_hash, mix, words_of

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract.  Possessive repeats and the look-behinds
# change no match; they keep the search linear on long runs.
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    for m in _EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind, then start; code points, end exclusive."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return spans


FEATURES = 24
#: What equal distant tokens gain by equal labels before any evidence; learning moves on from there.
SKIP_PRIOR = 6.0
LABELS = len(KINDS) + 1  # 0 is "none of them"


@dataclass
class Graph:
    """Nodes of a batch of documents and what joins them."""

    doc: np.ndarray
    start: np.ndarray  # code points, without leading and trailing marks
    end: np.ndarray
    features: np.ndarray
    label: np.ndarray  # of the pattern that covers a node, else 0
    chain: np.ndarray  # (edges, 2)
    skip: np.ndarray
    spans: list[list[tuple[int, int, int]]]


def _between(cumulative: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return cumulative[b] - cumulative[a]


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def graph_of(column: pa.Array) -> Graph:
    """Extract nodes, features, pattern labels and edges of every text of the column."""
    words = words_of(column)
    texts = column.to_pylist()
    data = words.data
    digit = (data >= 48) & (data <= 57)
    low = _LOWER[data]
    alpha = (low >= 97) & (low <= 122)
    at = data == 64
    dot, dash, plus, paren = data == 46, data == 45, data == 43, (data == 40) | (data == 41)
    digits, ats = _running(digit), _running(at)
    nodes = np.flatnonzero((_between(digits, words.starts, words.ends) > 0) | (_between(ats, words.starts, words.ends) > 0))
    raw_a, raw_b = words.starts[nodes], words.ends[nodes]
    # trim marks at both ends: the first and last byte that is a letter, digit, plus or non-ASCII
    solid = digit | alpha | plus | (data >= 128)
    places = np.flatnonzero(solid)
    has = _between(_running(solid), raw_a, raw_b) > 0
    a, b = raw_a.copy(), raw_b.copy()
    if len(places):
        a[has] = places[np.searchsorted(places, raw_a[has])]
        b[has] = places[np.searchsorted(places, raw_b[has]) - 1] + 1
    doc = words.doc_of()[nodes]
    points = _running((data & 0xC0) != 0x80)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    doc_at = np.concatenate([[0], np.cumsum(sizes)])
    start, end = points[a] - doc_at[doc], points[b] - doc_at[doc]

    n_digit, n_alpha = _between(digits, a, b), _between(_running(alpha), a, b)
    n_dot, n_dash = _between(_running(dot), a, b), _between(_running(dash), a, b)
    n_at, n_plus, n_paren = _between(ats, a, b), _between(_running(plus), a, b), _between(_running(paren), a, b)
    size = b - a
    f = np.zeros((len(nodes), FEATURES), np.float32)
    f[:, 0] = 1
    for j, edge in enumerate((1, 3, 5, 7, 10, 13, 16)):
        f[:, 1 + j] = n_digit >= edge
    f[:, 8], f[:, 9], f[:, 10] = n_digit > 19, n_alpha > 0, n_alpha > n_digit
    f[:, 11], f[:, 12], f[:, 13] = n_dot == 1, n_dot == 3, n_dot > 3
    f[:, 14], f[:, 15] = n_dash > 0, n_dash > 2
    f[:, 16], f[:, 17] = n_at == 1, n_at > 1
    f[:, 18], f[:, 19] = n_plus > 0, n_paren > 0
    f[:, 20], f[:, 21] = size > 24, n_digit + n_dot + n_dash == size
    f[:, 22], f[:, 23] = (n_at > 0) & (n_dot > 0), (n_dot == 3) & (n_digit + 3 == size)

    label = np.zeros(len(nodes), np.int64)
    spans: list = [[] for _ in texts]
    total = _between(digits, *(np.searchsorted(points, doc_at[i : len(texts) + i]) for i in (0, 1)))
    some = np.bincount(doc, minlength=len(texts)) > 0
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in np.flatnonzero(some):
        if total[d] >= 4 or "@" in texts[d]:
            spans[d] = base_spans(texts[d])
            own = slice(first[d], first[d + 1])
            for kind, x, y in spans[d]:
                i, j = np.searchsorted(end[own], x, "right"), np.searchsorted(start[own], y, "left")
                label[own][i:j] = kind + 1

    chain = np.flatnonzero((doc[1:] == doc[:-1]) & (nodes[1:] - nodes[:-1] <= 2))
    edges = [np.zeros((0, 2), np.int64)]
    for mask, least in ((digit | alpha, n_digit + n_alpha), (digit, n_digit)):
        seen = _running(mask)
        h = mix(_range_hash(low[mask].astype(np.uint64) + np.uint64(1), seen[a], seen[b], 0x9E3779B97F4A7C15))
        good = np.flatnonzero((least >= 6) & (n_digit + n_at > 0))
        order = good[np.lexsort((good, h[good], doc[good]))]
        same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
        edges.append(np.stack([order[:-1][same], order[1:][same]], 1))
    skip = np.unique(np.concatenate(edges), axis=0)
    return Graph(doc, start, end, f, label, np.stack([chain, chain + 1], 1), skip, spans)


@dataclass
class Model:
    """Potentials in logarithms: labels x features, and labels x labels for both kinds of edge."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _both(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])


def train(features: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300, decay: float = 1e-3) -> Model:
    """Maximise the pseudo-likelihood of the labels (Adam, fixed steps, so the same rows give the same model).

    Weights are drawn towards their prior means: 0, and ``SKIP_PRIOR`` for equal labels over a skip edge.
    """
    n, hot = len(label), np.eye(LABELS)
    neighbours = []
    for edges in (chain, skip):
        count = np.zeros((n, LABELS))
        target, source = _both(edges)
        np.add.at(count, target, hot[label[source]])
        neighbours.append(np.minimum(count, 2))
    x = np.concatenate([features, *neighbours], 1).astype(np.float64)
    prior = np.zeros((LABELS, x.shape[1]))
    prior[:, FEATURES + LABELS :] = SKIP_PRIOR * hot
    w = prior.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if n else 1):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - hot[label]).T @ x / n + decay * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    chain_w, skip_w = w[:, FEATURES : FEATURES + LABELS], w[:, FEATURES + LABELS :]
    return Model(w[:, :FEATURES], (chain_w + chain_w.T) / 2, (skip_w + skip_w.T) / 2)


def marginals(g: Graph, model: Model, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of every node by loopy belief propagation; labels of patterns are observed."""
    local = g.features.astype(np.float64) @ model.unary.T
    seen = g.label > 0
    local[seen] = np.where(np.eye(LABELS)[g.label[seen]] > 0, 0.0, -50.0)
    edges = np.concatenate([g.chain, g.skip])
    kind = np.repeat([0, 1], [len(g.chain), len(g.skip)])
    target, source = _both(edges)
    potential = np.stack([model.chain, model.skip])[np.concatenate([kind, kind])]
    message = np.zeros((len(target), LABELS))
    half = len(edges)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)]).astype(np.int64)

    def belief() -> np.ndarray:
        total = local.copy()
        np.add.at(total, target, message)
        return total

    for _ in range(rounds if half else 0):
        z = (belief()[source] - message[back])[:, None, :] + potential
        top = z.max(2, keepdims=True)
        new = np.log(np.exp(z - top).sum(2)) + top[..., 0]
        new -= new.max(1, keepdims=True)
        message = damping * message + (1 - damping) * new
    z = belief()
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = 4000) -> Model:
    """Learn the potentials from pattern labels on about ``documents`` documents chosen by a hash of id and text."""
    n = short_batches(docs).count()
    body = column(text)
    chance = F.pmod(F.xxhash64(column(doc_id), body), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(body.isNotNull() & (chance < min(1.0, documents / max(n, 1)))).select(body.alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            g = graph_of(batch.column("text"))
            flat = lambda e: [e.astype("<i4").tobytes()]
            packed = [np.packbits(g.features > 0, axis=1).tobytes()], flat(g.label), flat(g.chain), flat(g.skip)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in packed], ["f", "label", "chain", "skip"])

    rows = sorted(map(tuple, sample.mapInArrow(extract, "f binary, label binary, chain binary, skip binary").collect()))
    parts, base = [[np.zeros((0, FEATURES))], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]], 0
    for f, label, chain, skip in rows:
        label = np.frombuffer(label, "<i4").astype(np.int64)
        if not len(label):
            continue
        parts[0].append(np.unpackbits(np.frombuffer(f, np.uint8).reshape(len(label), -1), axis=1)[:, :FEATURES].astype(float))
        parts[1].append(label)
        for k, e in ((2, chain), (3, skip)):
            parts[k].append(np.frombuffer(e, "<i4").astype(np.int64).reshape(-1, 2) + base)
        base += len(label)
    return train(*(np.concatenate(p) for p in parts))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.9) -> DataFrame:
    """``doc_id, base, spans`` of every document: arrays of (kind, start, end), code points, end exclusive.

    ``base`` has the pattern matches; ``spans`` has them too, and each word that overlaps
    none of them and gets a label with probability ``least`` or more.  A null text
    counts as empty; ids may be null or repeat and repeated rows are answered alike; very long
    texts are one graph each; other columns are ignored whatever their names; an empty
    table gives no rows.
    """
    entry = "array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            g = graph_of(batch.column("text"))
            every = [list(s) for s in g.spans]
            if len(g.doc):
                p = marginals(g, model)
                best = p.argmax(1)
                for i in np.flatnonzero((best > 0) & (p.max(1) >= least) & (g.label == 0) & (g.end > g.start)):
                    x, y = int(g.start[i]), int(g.end[i])
                    if not any(a < y and x < b for _, a, b in g.spans[g.doc[i]]):
                        every[g.doc[i]].append((int(best[i]) - 1, x, y))
            as_rows = lambda spans: [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(s)] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(as_rows(g.spans), kind), pa.array(as_rows(every), kind)], ["doc_id", "base", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).mapInArrow(run, f"doc_id {kind}, base {entry}, spans {entry}")


def recovered(docs: DataFrame, model: Model, text: str = "text", share: int = 5, least: float = 0.9) -> DataFrame:
    """One row that measures the field: ``hidden, found, wrong, alone, found_alone``, counts of words.

    Of every ``share`` words with a pattern's label one is hidden, and the field is asked for it as
    for any other word: ``found`` of the ``hidden`` get their label back with probability
    ``least`` or more, ``wrong`` another label.  ``found_alone`` is what a field without skip
    potentials brings back.  ``alone`` counts the hidden words without a skip edge.
    """
    flat = Model(model.unary, model.chain, np.zeros_like(model.skip))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5, np.int64)
        for batch in slices(batches, "text"):
            g = graph_of(batch.column("text"))
            labelled = np.flatnonzero(g.label > 0)
            hidden = labelled[(g.start[labelled] + g.end[labelled]) % share == 0]
            if not len(hidden):
                continue
            want = g.label[hidden]
            g.label = g.label.copy()
            g.label[hidden] = 0
            p, q = marginals(g, model)[hidden], marginals(g, flat)[hidden]
            sure = p.max(1) >= least
            tied = np.isin(hidden, g.skip)
            total += [len(hidden), (sure & (p.argmax(1) == want)).sum(), (sure & (p.argmax(1) > 0) & (p.argmax(1) != want)).sum(), (~tied).sum(), ((q.max(1) >= least) & (q.argmax(1) == want)).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], ["hidden", "found", "wrong", "alone", "found_alone"])

    parts = docs.select(column(text).alias("text")).mapInArrow(run, "hidden long, found long, wrong long, alone long, found_alone long")
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def mask(text: str, spans: list) -> str:
    """Replace every span of a text by its kind in angle brackets (overlapping spans as one)."""
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"<{s['kind']}>"]
        last = max(last, s["end"])
    return "".join([*out, text[last:]])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
