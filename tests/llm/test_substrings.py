from __future__ import annotations

import random

import pytest
from helpers import SCHEMA, WORD, awkward

from tidewater.llm.substrings import remove_repeats


def _brute(rows, window):
    """rows: (doc_id, text) in their order; the first start of every window stays."""
    seen, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            seen.setdefault(tuple(words[d][i : i + window]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out[d] = (" ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone))
    return out


@pytest.mark.parametrize("window,anchor,seed", [(20, 8, 1), (20, 8, 2), (6, 3, 3), (5, 5, 4)])
def test_against_brute_force(spark, window, anchor, seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)] + ["a", "b"]
    passages = [rng.choices(words, k=rng.randrange(window - 2, 4 * window)) for _ in range(12)] + [["a"] * 60, ["a", "b"] * 40]
    texts = []
    for _ in range(70):
        text: list[str] = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            text += p[a:b] if rng.random() < 0.5 else p
            text += rng.choices(words, k=rng.randrange(6))
        texts.append(rng.choice([" ", "\n", "  \t"]).join(text))
    texts += [texts[3], None, "", " \n "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in remove_repeats(docs, window=window, anchor=anchor).collect()}
    assert got == _brute(rows, window)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by[5]] == [0, 0] and by[6][0].n_removed == 6000 and by[7][0].n_removed == by[7][0].n_words - (1 if by[7][0].kept else 0)
    assert by[0][0].kept == "" and by[1][0].n_words == 0
    assert sorted(r.n_words for r in by[None]) == [0, 60]


def test_texts_of_one_id_are_told_apart(spark):
    a, b = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = spark.createDataFrame([(1, a), (1, b), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_words) for r in remove_repeats(rows).collect())
    assert got == [(1, 0, 40), (1, 0, 40), (2, 40, 40)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
