from __future__ import annotations

import itertools

from tidewater.plans import catalog

STOP = "the and for with from after over into its this that will says said".split()


def test_whole_documents_meet(spark, tmp_path):
    common = " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i, j in itertools.product(range(8), range(8)))
    texts = [common, common + " extra", "short " + common[: len(common) // 3], None, "", common.replace("wordaa", "other"), common[:80] + " " + " ".join(f"tail{chr(97 + i)}" for i in range(20))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, common), (679, common)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {i: {w for w in (t or "").split() if w not in STOP} for i, t in rows}
    want = {}
    for i, e in itertools.product(sets, sets):
        if e < i and i - e <= 180 and sets[i] and sets[e]:
            j = len(sets[i] & sets[e]) / len(sets[i] | sets[e])
            if j >= 0.7 and (i not in want or (-j, e) < want[i]):
                want[i] = (-j, e)
    got = {r.item_id: (-r.jaccard, r.earlier_id) for r in catalog.QUERIES["story_assign_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: (round(j, 6), e) for i, (j, e) in want.items()} and got[679] == (-1.0, 500)
