from __future__ import annotations

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewater.llm.topk import MOST, best_of_tile, pieces, products, quantised, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(rows, queries, k):
    best = {}
    for i in queries:
        scores = [(-int(np.dot(rows[i], v)), j) for j, v in rows.items() if j != i and len(v) == len(rows[i])]
        best[i] = [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(x for v in best.values() for x in v)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = {int(i): rng.normal(0, 0.3, 6).astype(np.float32) for i in rng.permutation(500)[:180]}
    for i in list(vectors)[:40]:
        vectors[i + 1000] = vectors[i]  # ties
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], SCHEMA)
    rows = {i: np.floor(256 * v.astype(np.float64)).astype(np.int64) for i, v in vectors.items()}
    q = quantised(df)
    for shard_rows, block_rows, fan_in in ((8192, 1024, 32), (20, 7, 2)):
        got = top_k(q, q.where("vec_id % 5 = 0"), 5, shard_rows, block_rows, fan_in)
        assert sorted(tuple(r) for r in got.collect()) == _brute(rows, [i for i in rows if i % 5 == 0], 5)


def test_awkward_vectors(spark):
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [math.nan, 1.0], 0), (4, [math.inf, 1.0], 0), (None, [1.0, 1.0], 0)]
    good = [(0, [0.5, 0.5], 0), (5, [0.5, -0.5], 0), (6, [-0.25, 1.0], 0), (7, [3.0], 0), (8, [], 0)]
    df = spark.createDataFrame(bad + good, SCHEMA).selectExpr("*", "1 AS q", "2 AS dim", "3 AS shard", "4 AS Lane", "5 AS block")
    q = quantised(df)
    assert sorted(r.vec_id for r in q.collect()) == [0, 5, 6, 7, 8]
    got = sorted(tuple(r) for r in top_k(q, q).collect())
    rows = {0: [128, 128], 5: [128, -128], 6: [-64, 256], 7: [768], 8: []}
    assert got == _brute({k: np.array(v, np.int64) for k, v in rows.items()}, rows, 5)


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [65000.0] * 3, 0), (1, [65000.0, 64999.0, 1.0], 0)], SCHEMA)
    q = quantised(df)
    a, b = ([int(256 * x) for x in v] for v in ([65000.0] * 3, [65000.0, 64999.0, 1.0]))
    assert {r.score for r in top_k(q, q).collect()} == {sum(x * y for x, y in zip(a, b))}


def test_empty_table(spark):
    q = quantised(spark.createDataFrame([], SCHEMA))
    assert top_k(q, q).count() == 0


def _exact(rows, queries, k):
    exact = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = []
    for i in queries:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for h, a in dict.fromkeys((h, tuple(a)) for h, a in exact) for j, b in exact if h == i and j != i)
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return want


def test_large_and_repeated_vectors_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [3e6, 0.0]), (2, [2.0, 5.0]), (2, [70000.0, -1.0]), (2, [-9.0, 1.0]), (3, [65537.0, 2.0]), (3, [65537.0, 2.0]), (3, [65537.0, 2.0]), (0, [1.0, 0.0])]
    rows += [(4, [1e30, 1.0]), (5, [-1e30, 1.0]), (6, [0.0, 7.0]), (6, [0.0, 7.0])]  # the products of 4 and 5 with 6 are small
    q = quantised(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    for shard_rows in (8192, 2):
        got = sorted(tuple(r) for r in top_k(q, q.where("vec_id = 6"), 9, shard_rows).collect())
        assert got == _exact(rows, [6], 9)
        few = q.where("vec_id NOT IN (4, 5)")
        got = sorted(tuple(r) for r in top_k(few, few.where("vec_id IN (0, 2)"), 4, shard_rows).collect())
        assert got == _exact([r for r in rows if r[0] not in (4, 5)], (0, 2), 4)


def test_a_hot_vector_is_dealt_over_the_lanes(spark):
    rows = [(7, [1.0, 2.0])] * 3000 + [(i + 100, [float(i % 7), 1.0]) for i in range(1500)]
    q = quantised(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3))
    got = pieces(q, 8, len(rows)).groupBy("lane").agg(F.sum(F.length("ids") / 8).alias("rows")).collect()
    assert len(got) == 8 and sum(r.rows for r in got) == 4500 and max(r.rows for r in got) < 2 * 4500 / 8
    found = sorted(tuple(r) for r in top_k(q, q.where("vec_id IN (7, 150)"), 4, 600).collect())
    assert found == _exact(rows, (7, 150), 4)


def test_own_rows_leave_room_for_others():
    ids = np.array([7, 7, 7, 1, 2])
    shard = np.array([[9.0], [8], [7], [2], [1]])
    assert [x.tolist() for x in best_of_tile(np.array([7]), np.array([[1.0]]), ids, shard, 2)] == [[7, 7], [1, 2], [2, 1]]


def test_scores_beyond_64_bits_are_refused(spark):
    big = np.array([[2.0**40, 2.0**40], [2.0**40, -(2.0**40)], [3.0, 5.0]])
    assert products(big, big).tolist() == [[MOST, 0, 8 << 40], [0, MOST, -2 << 40], [8 << 40, -2 << 40, 34]]
    q = quantised(spark.createDataFrame([(1, [1e30], 0), (2, [1e30], 0), (3, [1.0], 0)], SCHEMA))
    with pytest.raises(Exception, match="leaves 64 bits"):
        top_k(q, q.where("vec_id = 1"), 1).collect()


def test_products_of_every_size_are_exact():
    rng = np.random.default_rng(8)
    for bits in (6, 12, 20, 26, 31, 40):
        a, b = (np.floor(rng.normal(0, 2.0**bits, (6, 5))) for _ in range(2))
        b[0] = 1
        want = [[max(-MOST, min(MOST, sum(int(x) * int(y) for x, y in zip(i, j)))) for j in b] for i in a]
        assert products(a, b).tolist() == want
