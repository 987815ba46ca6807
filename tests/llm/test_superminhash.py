from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import SCHEMA, WORD, awkward, documents

from tidewater.llm.superminhash import BANDS, ROWS, band_tokens, minhash_groups, signatures
from tidewater.llm.textkit import mix


def _shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


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
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def _edited(rng, words, edits, vocabulary):
    w = list(words)
    for _ in range(edits):
        p = rng.randrange(len(w))
        kind = rng.random()
        w[p : p + 1] = [rng.choice(vocabulary)] if kind < 0.6 else [] if kind < 0.8 else [w[p], rng.choice(vocabulary)]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts: list[str] = []
    for size in (2, 4, 6, 9, 20, 40, 90, 160, 400):
        for _ in range(3):
            base = rng.choices(vocabulary, k=size)
            texts += [_edited(rng, base, rng.randrange(0, 2 + size // 25), vocabulary) for _ in range(rng.randrange(1, 9))]
    shared = rng.choices(vocabulary, k=60)  # a passage that unrelated texts share
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)) + shared + rng.choices(vocabulary, k=rng.randrange(5, 30))) for _ in range(30)]
    family = rng.choices(vocabulary, k=120)  # many near copies, some beyond the similarity
    texts += [_edited(rng, family, rng.randrange(0, 9), vocabulary) for _ in range(60)]
    rng.shuffle(texts)
    texts += [texts[0].upper(), texts[1]]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_groups(documents(spark, texts).repartition(3)).collect()}
    assert got == _brute(texts)


def test_awkward_rows(spark):
    docs = awkward(spark, ["ONE", "two  words", "words two"]).selectExpr("*", "1 AS token", "2 AS tokens", "3 AS Comp", "4 AS weight", "5 AS A")
    rows = minhash_groups(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].component_id for i in (0, 1, 2)] == [0, 1, 2] and by[0].n_shingles == 0 and by[0].kept
    assert by[6].component_id == by[5].component_id == 5 and by[7].component_id == 5 and not by[6].kept and by[5].kept
    assert by[9].component_id == 3 and by[10].component_id == 4 and by[11].component_id == 11
    assert all(r.kept for r in rows if r.doc_id is None)
    assert minhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def _signature(elements, m):
    """The signature one element and one step at a time, each permutation written out."""
    best = [(1 << 64) - 1] * m
    for x in elements:
        order = list(range(m))
        for step in range(m):
            drawn = int(mix(np.array([(int(x) + (step + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
            k = step + ((drawn >> 32) * (m - step) >> 32)
            order[step], order[k] = order[k], order[step]
            best[order[step]] = min(best[order[step]], step << 32 | drawn & 0xFFFFFFFF)
    return best


def test_signatures_are_those_of_full_permutations():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 0, 2, 7, 40, 300, 3000)]
    got = signatures(sets, 16)
    for s, row in zip(sets, got):
        assert row.tolist() == (_signature(s, 16) if len(s) else [(1 << 64) - 1] * 16)


def test_positions_agree_like_the_sets():
    rng = np.random.default_rng(5)
    agree = []
    for n in (12, 60, 400):
        for share in (0.5, 0.8):
            errors = []
            for _ in range(60):
                both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                cut = int(n * share)
                own = (n - cut) // 2
                a, b = both[: cut + own], np.concatenate([both[:cut], both[cut + own :]])
                x, y = signatures([a, b], BANDS * ROWS)
                errors.append((x == y).mean() - cut / n)
            spread = (share * (1 - share) / (BANDS * ROWS)) ** 0.5
            assert abs(np.mean(errors)) < 3 * spread / 60**0.5 + 0.005
            agree.append(np.std(errors) / spread)
    assert np.mean(agree) < 1.0  # independent minima would have 1


def test_bands_of_different_places_differ():
    tokens = band_tokens(np.zeros((2, BANDS * ROWS), np.uint64))
    assert len(set(tokens[0].tolist())) == BANDS and (tokens[0] == tokens[1]).all()
