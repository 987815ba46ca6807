from __future__ import annotations

import itertools
import random

from tidewater.operators import alike


def test_no_similar_pair_is_left_out_and_common_words_bring_none(spark):
    rng = random.Random(3)
    subjects = [rng.sample(range(2000), rng.choice([1, 2, 3, 9, 40])) for _ in range(40)]
    rows = []
    for i in range(400):
        words = {f"w{x}" for x in rng.choice(subjects) if rng.random() < 0.93} | {f"w{x}" for x in rng.sample(range(2000), rng.choice([0, 0, 1, 2]))}
        rows.append((i, rng.randrange(100_000), sorted(words) + (["common", "words", "everywhere"] if i % 2 else [])))
    got = [(r.a_id, r.b_id) for r in alike.candidates(spark.createDataFrame(rows, "item_id long, t long, words array<string>"), 0.7, 20_000).collect()]
    near = [(a[0], b[0], len(set(a[2]) & set(b[2])) / (len(set(a[2]) | set(b[2])) or 1)) for a, b in itertools.combinations(rows, 2) if abs(a[1] - b[1]) <= 20_000]
    want = {(a, b) for a, b, j in near if j >= 0.7}
    assert len(got) == len(set(got)) and want and want <= set(got)
    assert len(got) < len(near) / 4 and {(a, b) for a, b, j in near if j == 0}.isdisjoint(got)
