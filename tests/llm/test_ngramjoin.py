from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import SCHEMA, WORD, awkward, documents

from tidewater.llm.common import components
from tidewater.llm.ngramjoin import HEAVY, _met, near_duplicates, shingle_sets, sketches


def _shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute(texts):
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def _edited(rng, words, edits, vocabulary):
    w = list(words)
    for _ in range(edits):
        p = rng.randrange(len(w))
        kind = rng.random()
        w[p : p + 1] = [rng.choice(vocabulary)] if kind < 0.6 else [] if kind < 0.8 else [w[p], rng.choice(vocabulary)]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts: list[str] = []
    for size in (3, 5, 8, 20, 40, 90, 160, 400):
        for _ in range(3):
            base = rng.choices(vocabulary, k=size)
            texts += [_edited(rng, base, rng.randrange(0, 2 + size // 25), vocabulary) for _ in range(rng.randrange(1, 9))]
    shared = rng.choices(vocabulary, k=60)  # a passage that unrelated texts share
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)) + shared + rng.choices(vocabulary, k=rng.randrange(5, 30))) for _ in range(30)]
    family = rng.choices(vocabulary, k=120)  # many near copies, some beyond the similarity
    texts += [_edited(rng, family, rng.randrange(0, 9), vocabulary) for _ in range(60)]
    rng.shuffle(texts)
    texts += [texts[0].upper(), texts[1]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, texts).repartition(3)).collect()}
    assert got == _brute(texts)


def test_awkward_rows(spark):
    docs = awkward(spark, ["ONE", "two  words", "words two"])
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].component_id for i in (0, 1, 2)] == [0, 1, 2] and by[0].n_shingles == 0
    assert by[6].component_id == by[5].component_id == 5 and by[7].component_id == 5
    assert by[9].component_id == 3 and by[10].component_id == 4 and by[11].component_id == 11


def test_repeated_ids_are_one_document_per_text(spark):
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(400)], k=120)
    near = [*base[:60], "edited", *base[61:]]
    rows = [(7, " ".join(base))] * 40 + [(3, " ".join(near))] * 30 + [(5, "some other text of more than five words")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs).collect()
    assert len(got) == 75 and {(r.doc_id, r.component_id) for r in got} == {(7, 3), (3, 3), (5, 5)}


def test_only_the_result_stays_in_the_shared_folder(spark):
    import glob

    from tidewater.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/tidewater-*"))
    near_duplicates(documents(spark, ["a text of a few words and more"] * 3)).count()
    assert len(set(glob.glob(f"{folder}/tidewater-*")) - before) == 1


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_long_and_wide_graphs(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (60, 2))]
    edges = [*chain, *star, *loose, (7, 7), (9, 8), (9, 8)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: find(n) for n in root if find(n) != n}
    assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_group_just_too_far_apart_meets_in_few_pairs(spark):
    import pyarrow as pa

    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    family = rng.choices(vocabulary, k=150)
    texts = [_edited(rng, family, 12, vocabulary) for _ in range(3 * HEAVY)]
    sets = shingle_sets(pa.array(texts))
    drawn = sketches(sets).view(np.uint64)
    rows = [(1, d, len(s), 0, 1, d, -1, [int(x) for x in k.view(np.int64)]) for d, (s, k) in enumerate(zip(sets, drawn))]
    mixed = spark.createDataFrame(rows, "token long, doc long, n int, pos int, matches int, comp long, main long, sketch array<long>")
    for a, x in zip(sets, drawn):
        for b, y in zip(sets, drawn):
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
    plain, told = ({(r.x, r.y) for r in _met(mixed, 75, s).collect()} for s in (False, True))
    near = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))}
    assert near <= told <= plain and len(told) < len(plain) // 2
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == _brute(texts)
