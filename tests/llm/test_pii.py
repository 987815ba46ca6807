from __future__ import annotations

import itertools
import random
import re

import numpy as np

import pytest
from helpers import SCHEMA, awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.pii import FEATURES, KINDS, LABELS, Graph, Model, _luhn, base_spans, find, fit, marginals, mask, recovered

# The contract's patterns as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARDS = ["4111111111111111", "5500 0000 0000 0004", "6011-0009-9013-9424"]


def _plain(text):
    spans = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and _luhn(d)]
    return spans + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+-() 9é4", max_size=40))
def test_patterns_keep_their_matches(text):
    assert base_spans(text) == _plain(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1 " * 60_000, "@a" * 50_000])
def test_patterns_stay_linear(text):
    base_spans(text)


def test_spans_of_documents(spark):
    rng = random.Random(2)
    bits = ["x@y.co", "a.b@c-d.e.fg", "10.0.0.1", "300.1.2.3", "1.2.3.4.5", "+1 (555) 123-4567", "+49 30 1234567", *CARDS, "4111111111111112", "plain", "é😀", "3.14", "12"]
    texts = [" ".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(200)]
    docs = documents(spark, texts).repartition(3)
    for r in find(docs, fit(docs)).collect():
        text = texts[r.doc_id]
        assert [(KINDS.index(s.kind), s.start, s.end) for s in r.base] == _plain(text)
        every = {(s.kind, s.start, s.end) for s in r.spans}
        assert every >= {(s.kind, s.start, s.end) for s in r.base}


def test_skip_chains_add_repeats_of_what_was_found(spark):
    train = documents(spark, ["call +15551234567 or pay with 4111111111111111 from 10.0.0.1 by me@x.org in 2024"] * 40 + ["only 12 words and 3.14 here"] * 40)
    model = fit(train)
    text = "card 4111-1111-1111-1111 then 4111.1111.1111.1111 and é 15551234567 after +15551234567 , 20240101 x"
    row = find(documents(spark, [text]), model).first()
    added = {(s.kind, text[s.start : s.end]) for s in row.spans} - {(s.kind, text[s.start : s.end]) for s in row.base}
    assert added == {("card", "4111.1111.1111.1111"), ("phone", "15551234567")}
    assert mask(text, row.spans) == "card <card> then <card> and é <phone> after <phone> , 20240101 x"
    apart = documents(spark, ["15551234567 alone", "nothing 4111.1111.1111.1111"])
    assert all(not r.spans for r in find(apart, model).collect())


def test_awkward_rows(spark):
    docs = awkward(spark, ["x@y.co " * 3000])
    rows = find(docs, fit(docs)).collect()
    assert len(rows) == docs.count() and len(next(r for r in rows if r.doc_id == 9).base) == 3000
    empty = spark.createDataFrame([], SCHEMA)
    assert find(empty, fit(empty)).count() == 0


def _enumerated(g, model):
    """Label probabilities by the sum over all labellings."""
    n = len(g.doc)
    local = g.features @ model.unary.T
    total = np.zeros((n, LABELS))
    for labels in itertools.product(range(LABELS), repeat=n):
        if any(g.label[i] and labels[i] != g.label[i] for i in range(n)):
            continue
        z = sum(0.0 if g.label[i] else local[i, labels[i]] for i in range(n))
        z += sum(model.chain[labels[i], labels[j]] for i, j in g.chain) + sum(model.skip[labels[i], labels[j]] for i, j in g.skip)
        for i in range(n):
            total[i, labels[i]] += np.exp(z)
    return total / total.sum(1, keepdims=True)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    for chain, skip, exact in (([(0, 1), (1, 2), (3, 4)], [(2, 5), (0, 3)], True), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], False)):
        n = 6 if exact else 4
        chain_w, skip_w = (rng.normal(0, 0.5, (LABELS, LABELS)) for _ in range(2))
        model = Model(rng.normal(0, 1, (LABELS, FEATURES)), (chain_w + chain_w.T) / 2, (skip_w + skip_w.T) / 2)
        label = np.zeros(n, np.int64)
        label[1] = 2
        g = Graph(np.zeros(n, np.int64), np.arange(n), np.arange(n) + 1, rng.integers(0, 2, (n, FEATURES)).astype(float), label, np.array(chain), np.array(skip), [[]])
        # without a loop the messages are exact; around one they are near
        assert np.abs(marginals(g, model, 60) - _enumerated(g, model)).max() < (1e-6 if exact else 0.15)


def test_hidden_labels_come_back_over_skip_edges(spark):
    rng = random.Random(2)
    texts = []
    for i in range(300):
        card = rng.choice(CARDS).replace(" ", "").replace("-", "")
        mail = f"user{i}x{rng.randrange(99)}@mail{rng.randrange(9)}.example.org"
        words = [f"w{rng.randrange(90)}" for _ in range(30)] + ["".join(rng.choices("0123456789", k=16)) for _ in range(2)]
        for x in (card, card, mail, mail):
            words.insert(rng.randrange(len(words)), x)
        texts.append(" ".join(words))
    docs = documents(spark, texts).selectExpr("*", "1 AS `doc.id`", "2 AS LABEL")
    got = recovered(docs, fit(docs)).first()
    assert got.hidden > 100 and got.found >= 0.6 * (got.hidden - got.alone) and got.wrong <= 0.02 * got.hidden and got.found > 10 * got.found_alone
    assert find(docs.withColumnRenamed("doc_id", "id.of doc"), fit(docs), "id.of doc").count() == 300
    assert recovered(spark.createDataFrame([], SCHEMA), fit(docs)).first().hidden == 0
