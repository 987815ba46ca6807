from __future__ import annotations

import random

import pytest
from helpers import SCHEMA, awkward, documents

import corpus_pipeline


@pytest.fixture
def stages():
    return dict(corpus_pipeline.STAGES)


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "kstm" for b in ("ala", "eno", "iru") for c in ("n", "pe", "ri", "do", "x")]
    line = lambda k: " ".join(rng.choices(words, k=k))
    item = line(25)
    texts = ["\n".join(line(rng.randrange(8, 30)) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    texts += ["12 34", None, "", texts[3], texts[4].replace("\n", " \n"), texts[5] + " " + item, texts[6] + "\n" + texts[7]]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), texts


def test_each_stage_decides(spark, folder, stages):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    one = stages["language id"](spark, docs, path)
    assert sorted(r.doc_id for r in one.collect()) == [i for i in range(67) if i not in (60, 61, 62)]
    two = {r.doc_id: r for r in stages["line dedup"](spark, one, path).collect()}
    assert 63 not in two and 66 not in two and len(two) == 62 - (64 not in two)
    assert all(r.n_chars == len(r.text) for r in two.values()) and two[0].text == texts[0]
    near = stages["n-gram Jaccard join"](spark, docs, path)
    left = {r.doc_id for r in near.collect()}
    assert 63 not in left and 64 not in left and left >= set(range(63))
    clean = {r.doc_id for r in stages["benchmark decontamination"](spark, docs, path).collect()}
    assert clean == set(range(67)) - {65}
    for name, stage in list(stages.items())[:-1]:
        assert stage(spark, docs, path).schema.names == docs.columns, name


def test_run_applies_all_stages(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in got}
    assert ids.isdisjoint({60, 61, 62, 63, 65, 66}) and ids >= set(range(60))
    assert all(r.length > 0 for r in got)


def test_awkward_and_empty_tables(spark, folder, stages):
    path, _ = folder
    docs = awkward(spark).select(*[f.split()[0] for f in SCHEMA.split(", ")])
    empty = spark.createDataFrame([], SCHEMA)
    for stage in stages.values():
        assert stage(spark, docs, path).count() > 0
        assert stage(spark, empty, path).count() == 0


def test_line_stage_removes_short_repeats(spark, folder, stages):
    path, texts = folder
    docs = documents(spark, [f"{t}\nA footer" for t in texts[:9]])
    got = {r.doc_id: r.text for r in stages["line dedup"](spark, docs, path).collect()}
    assert got[0].endswith("\nA footer") and not any("A footer" in got[i] for i in range(1, 9))


def test_rows_are_told_apart_by_more_than_their_id(spark, folder, stages):
    path, texts = folder
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[8]), (None, texts[9]), (9, texts[9]), (4, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, docs, path).collect()]
    want = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[8]), (9, texts[9]), (4, None), (None, None), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_unlabelled_corpus_keeps_its_texts(spark, folder, stages):
    path, texts = folder
    docs = documents(spark, texts).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    assert {r.doc_id for r in stages["language id"](spark, docs, path).collect()} == set(range(67)) - {60, 61, 62}


def test_extra_columns_of_any_name_are_carried(spark, folder, stages):
    path, texts = folder
    names = ["lang_pred", "score", "removed_lines", "key", "doc", "_td_key", "goes", "id", "a.b", "group"]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *[f"'{i}' AS `{n}`" for i, n in enumerate(names)])
    for name, stage in list(stages.items())[:-1]:
        got = stage(spark, docs, path)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) > 50 and all(tuple(r)[5:] == tuple(str(i) for i in range(len(names))) for r in rows), name
    assert stages["packing"](spark, docs, path).count() > 60


def _brute(texts, item):
    """The pipeline in plain Python, for labelled texts: which documents stay, and their texts."""
    from test_lines import _brute as lines_gone
    from test_ngramjoin import _brute as components_of

    from tidewater.llm.decontaminate import LEAST, MATCH
    from test_decontaminate import _score

    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    gone = lines_gone(sorted(left.items()))
    cut = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in left.items()}
    cut = {i: t for i, t in cut.items() if t}
    order = sorted(cut)
    groups = components_of([cut[i] for i in order])
    cut = {i: cut[i] for k, i in enumerate(order) if groups[k][1] == k}
    return {i: t for i, t in cut.items() if _score(item.split(), t.lower().split()) < LEAST * MATCH * len(item.split())}


def test_whole_pipeline_against_brute_force(spark, folder):
    import zlib

    import numpy as np
    from test_packing import _reference_ids

    path, texts = folder
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    want = {i: [len(_reference_ids(t)), zlib.crc32(_reference_ids(t).tobytes())] for i, t in _brute(texts, item).items()}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: [r.doc_tokens, r.ids_crc32] for r in got if r.length == r.doc_tokens} == want
    assert len(got) == len(want) and sum(r.length for r in got) == np.sum([n for n, _ in want.values()])
