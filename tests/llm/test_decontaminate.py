from __future__ import annotations

import random

import numpy as np
from helpers import SCHEMA, awkward, documents

from tidewater.llm.decontaminate import GAP, MATCH, MISMATCH, clean, contaminated, least_seeds, room, smith_waterman

ITEMS = "item_id long, text string"


def _score(a, b):
    """Smith-Waterman cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (MATCH if x == y else MISMATCH), h[i][j + 1] + GAP, h[i + 1][j] + GAP)
    return max(map(max, h))


def test_alignment_against_cells():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(0, 20))
        score, start, end = smith_waterman(a, b)
        assert score == _score(a.tolist(), b.tolist())
        assert _score(a.tolist(), b[start:end].tolist()) == score


def _corpus(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(800)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(12, 50))) for _ in range(30)]
    texts, want = [], set()
    for d in range(300):
        words = rng.choices(vocabulary, k=rng.randrange(0, 300))
        if d % 3 == 0:
            i = rng.randrange(30)
            w = items[i].split()
            if d % 2:  # every fifth word replaced, one dropped, marks and capitals
                w = [rng.choice(vocabulary) if k % 5 == 4 else x for k, x in enumerate(w)]
                del w[len(w) // 2]
                w = [x.upper() + "," for x in w]
            at = rng.randrange(len(words) + 1)
            words[at:at] = w
            want.add((d, i))
        texts.append(" ".join(words))
    return documents(spark, texts).repartition(3), spark.createDataFrame(list(enumerate(items)), ITEMS), want


def test_copies_are_found_and_nothing_else(spark):
    docs, items, want = _corpus(spark)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == want
    bad = {d for d, _ in want}
    assert {r.doc_id for r in clean(docs, items).collect()} == set(range(300)) - bad


def test_a_benchmark_in_parts_gives_the_same(spark, monkeypatch):
    from tidewater.llm import decontaminate

    docs, items, want = _corpus(spark)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 300)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == want
    assert clean(docs, items).count() == 300 - len({d for d, _ in want})


def test_a_passage_in_every_document_is_still_found(spark):
    docs = documents(spark, [f"a{i} b{i} some words that every one of these documents repeats in full c{i}" for i in range(50)])
    items = spark.createDataFrame([(1, "some words that every one of these documents repeats in full")], ITEMS)
    assert contaminated(docs, items).count() == 50


def test_awkward_rows(spark):
    docs = awkward(spark, ["copy of the item that is asked for here", "item"])
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "of the item that is asked for"), (4, "of the item that is asked for"), (None, "no id no id no id no id")], ITEMS)
    got = contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id is not None) == [(9, 4), (9, 4)]
    assert [(r.doc_id, r.item_id) for r in got if r.doc_id is None] == [(None, None)]
    left = clean(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    empty = spark.createDataFrame([], SCHEMA)
    assert contaminated(empty, items).count() == clean(empty, items).count() == 0
    assert contaminated(docs, items.where("false")).count() == 0 and clean(docs, items.where("false")).count() == docs.count()


def test_query_against_every_alignment(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [rng.choices(vocabulary, k=rng.randrange(14, 30)) for _ in range(8)]
    texts = []
    for d in range(50):
        words = rng.choices(vocabulary, k=rng.randrange(5, 60))
        if d % 2:
            copy = list(rng.choice(items))
            for p in rng.sample(range(len(copy)), len(copy) // 6):  # every sixth word or so is another one
                copy[p] = rng.choice(vocabulary)
            words[rng.randrange(len(words)) : 0] = copy
        texts.append(words)
    want = {}
    for d, words in enumerate(texts):
        for i, item in enumerate(items):
            share = _score(item, words) / (MATCH * len(item))
            if share >= 0.5:
                want[d, i] = share
    docs = documents(spark, [" ".join(t) for t in texts]).repartition(3)
    rows = contaminated(docs, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], ITEMS)).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 20


def _edits(rng, item, vocabulary):
    """Copies by the classes of edits that leave about the threshold."""
    other = lambda: rng.choice(vocabulary)
    yield [other() if k % 3 == 2 else x for k, x in enumerate(item)]  # every third word replaced
    yield [y for k, x in enumerate(item) for y in ([x, other()] if k % 2 else [x])]  # one inserted after every second
    yield [y for x in item for y in (x, other())][:-1]  # after every one
    yield [y for k, x in enumerate(item) for y in ([x, other(), other()] if k % 3 == 2 else [x])]  # two after every third
    yield [x for k, x in enumerate(item) if k % 4]  # every fourth dropped
    yield item[: len(item) // 2 + 1]  # the first half
    mixed = list(item)
    for _ in range(len(item) // 3):
        p = rng.randrange(len(mixed))
        mixed[p : p + 1] = rng.choice([[other()], [], [mixed[p], other()]])
    yield mixed


def test_every_class_of_edits_is_found(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    items = [rng.choices(vocabulary, k=n) for n in (3, 4, 5, 6, 7, 8, 12, 20, 33, 60)]
    texts = [rng.choices(vocabulary, k=rng.randrange(40)) + copy + rng.choices(vocabulary, k=rng.randrange(40)) for item in items for copy in _edits(rng, item, vocabulary)]
    want = {}
    for d, words in enumerate(texts):
        for i, item in enumerate(items):
            share = _score(item, words) / (MATCH * len(item))
            if share >= 0.5:
                want[d, i] = round(share, 9)
    rows = contaminated(documents(spark, [" ".join(t) for t in texts]), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], ITEMS)).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in rows} == want and len(want) > 40


def test_least_seeds_holds_for_every_alignment():
    """Every string of edits of a short item: what reaches the threshold meets so many seeds and takes so much room."""
    import itertools

    for n in range(4, 8):
        fewest, longest = n, 0
        # per item word: matched, replaced or dropped, and how many words are inserted behind it
        for kinds in itertools.product("mrd", repeat=n):
            for inserted in itertools.product(range(3), repeat=n - 1):
                if MATCH * kinds.count("m") - (n - kinds.count("m")) - sum(inserted) < n:
                    continue
                fewest = min(fewest, sum(a == b == "m" and k < 2 for a, b, k in zip(kinds, kinds[1:], inserted)))
                longest = max(longest, n - kinds.count("d") + sum(inserted))
        assert max(1, least_seeds(n, 0.5)) <= max(1, fewest) and longest <= room(n, 0.5)
        assert fewest >= 1 or n < 4
