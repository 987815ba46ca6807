from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm.hardnegatives import Lane, hard_negatives
from tidewater.llm.topk import MOST, quantised

SCHEMA = "vec_id long, embedding array<float>, label int"


def _exact(rows, picked):
    """The contract by Python integers; rows are (id, components, label), equal anchors count once."""
    whole = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), c) for i, v, c in rows if i is not None and c is not None]
    out = []
    for i, a, c in dict.fromkeys(r for r in whole if picked(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, d == c) for j, b, d in whole if j != i and len(a) == len(b))
        for p, j, _ in [x for x in scored if x[2]][:5]:
            inside = [(s, n) for s, n, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(inside[:3])]
    return sorted(out)


def _found(spark, rows, where, **more):
    q = quantised(spark.createDataFrame([(i, [float(x) for x in v], c) for i, v, c in rows], SCHEMA).repartition(3), more={"label": F.col("label")})
    return sorted(tuple(r) for r in hard_negatives(q, q.where(where), **more).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in rng.permutation(900)[:420]:
        # norms differ; a third of the rows have one label
        rows.append((int(i), rng.normal(0.2, 0.3, 8).astype(np.float32) * np.float32(rng.choice([0.2, 1, 3])), int(rng.choice([0, 0, 1, 2, 3]))))
    rows += [(i + 2000, v, c) for i, v, c in rows[:60]]  # ties
    rows += [(i + 4000, v, (c + 1) % 4) for i, v, c in rows[:30]]
    want = _exact(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    for more in ({}, {"shard_rows": 40, "block_rows": 7}):
        assert _found(spark, rows, "vec_id % 10 = 0", **more) == want


def test_awkward_rows(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (0, [2.0, 0.0], 2), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.6, 0.5], 2), (3, [0.6, 0.5], 3), (4, [1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0], 1), (5, [3.0], 1), (10, [2.0], 1), (6, [], 1), (7, [-1.0, -1.0], 1), (8, [1e20, 0.1], 9), (9, [0.0, 0.0], 2), (20, [0.0, 0.0], 2)]
    got = _found(spark, rows, "vec_id IN (0, 10, 7, 20)")
    assert got == _exact(rows, lambda i: i in (0, 10, 7, 20)) and got
    df = spark.createDataFrame([(1, None, 1), (2, [None, 1.0], 1), (3, [math.nan, 1.0], 1), (4, [math.inf, 0.0], 2)], SCHEMA).selectExpr("*", "1 AS lane", "2 AS Block", "3 AS uid", "4 AS low", "5 AS window")
    q = quantised(df, more={"label": F.col("label")})
    assert hard_negatives(q, q).count() == 0
    empty = quantised(spark.createDataFrame([], SCHEMA), more={"label": F.col("label")})
    assert hard_negatives(empty, empty).count() == 0


def test_buckets_are_passed_over_and_nothing_is_lost():
    rng = np.random.default_rng(6)
    m = np.floor(rng.normal(0, 60, (4000, 8)) * np.exp(rng.normal(0, 1.2, (4000, 1))))
    labels = rng.integers(0, 3, 4000)
    ids = np.arange(4000)
    lane = Lane(ids, labels, m, bucket=50)
    anchors = m[:20]
    for low, high, same, k in ((-MOST, MOST, True, 5), (400_000, 700_000, False, 3), (5, 4, False, 3)):
        lane.met = 0
        got = {(i, w): (list(x), list(s)) for i, w, x, s in lane.search(ids[:20], labels[:20], anchors, np.full((20, 1), low), np.full((20, 1), high), same, k)}
        assert lane.met < 0.7 * 20 * 4000
        for i in range(20):
            score = anchors[i] @ m.T
            fits = [j for j in sorted(range(4000), key=lambda j: (-score[j], j)) if j != i and (labels[j] == labels[i]) == same and low <= score[j] <= high][:k]
            assert got.get((i, 0), ([], [])) == (fits, [int(score[j]) for j in fits])
