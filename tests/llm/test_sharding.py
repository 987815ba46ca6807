from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents

from tidewater.llm.sharding import lookup_table, place, write_shards


def _turns(names, slots):
    """The same filling with each shard's whole permutation written out."""
    import hashlib

    orders = []
    for s in names:
        d = hashlib.md5(s.encode()).digest()
        a, b = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:], "little") % (slots - 1) + 1
        orders.append(iter([(a + j * b) % slots for j in range(slots)]))
    owner: dict[int, int] = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(x for x in order if x not in owner)] = i
    return [owner[i] for i in range(slots)]


def test_table_against_written_permutations():
    names = [f"n{i}" for i in range(7)]
    assert list(lookup_table(names, 251)) == _turns(names, 251)


def test_table_is_even_and_moves_little():
    names = [f"n{i}" for i in range(20)]
    before, after = lookup_table(names, 4099), lookup_table(names[:-1], 4099)
    counts = Counter(before.tolist()).values()
    assert max(counts) - min(counts) <= 1
    moved = np.mean((before != after) & (before != 19))
    assert moved < 0.1


def test_bad_tables():
    for names, slots in ((["a", "a"], 7), ([], 7), (["a"], 8), ([str(i) for i in range(9)], 7)):
        with pytest.raises(ValueError):
            lookup_table(names, slots)


def test_every_row_is_placed(spark):
    docs = awkward(spark)
    names = ["a", "b", "c"]
    rows = place(docs, "doc_id", names, 101).collect()
    owner = lookup_table(names, 101)
    assert len(rows) == docs.count() and all(r.shard == names[owner[r.slot]] for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    with pytest.raises(ValueError):
        place(docs.selectExpr("*", "1 AS slot"), "doc_id", names)
    assert place(docs.where("false"), "doc_id", names).count() == 0


def test_plan_moves_nothing(spark):
    placed = place(spark.range(1000), "id", ["a", "b"], 101)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_written_shards(spark, tmp_path):
    write_shards(place(documents(spark, ["x"] * 200), "doc_id", ["a", "b"], 101), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


