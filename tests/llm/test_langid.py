from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward

from tidewater.llm.langid import UNDETERMINED, Trigrams, fit, held_out, identify, score_floor, trigrams_of

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "so"], "bb": ["str", "enz", "ach", "ung", "wer"], "cc": ["ção", "inho", "que", "ões", "lha"]}


def _labelled(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(4, 40)))
        rows.append((i, text, lang, None, len(text)))
    return spark.createDataFrame(rows, SCHEMA)


def test_held_out_accuracy(spark):
    docs = _labelled(spark).repartition(3)
    # labels of held-out rows are wrong on purpose: nothing may be learned from them
    poisoned = docs.withColumn("lang", docs.lang).selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'zz' ELSE lang END AS lang", "source", "n_chars")
    profiles = fit(poisoned)
    assert profiles.languages == sorted(SYLLABLES)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in identify(docs, profiles).collect()}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 50 and np.mean([got[i].lang_pred == truth[i] for i in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    flags = {r.doc_id: r.h for r in docs.select("doc_id", held_out(docs.doc_id).alias("h")).collect()}
    assert {i for i, h in flags.items() if h} == set(test)


def test_bundles_against_letters_one_by_one():
    grams = Trigrams(64, 5)
    texts = ["Ab, c!", "", "É é", "a" * 50, None, "12 34", "x\ny"]
    which, ids, n, lettered = trigrams_of(texts)
    assert lettered.tolist() == [True, False, True, True, False, False, True]
    for d, t in enumerate(texts):
        codes = [0]
        for c in t or "":
            code = 1 + ord(c.lower()) % 1023 if c.isalpha() else 0
            if code or codes[-1]:
                codes.append(code)
        codes.append(0)
        want = np.zeros(64)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            if b:
                letters = grams.places[2].astype(int)
                want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        own = which == d
        assert np.array_equal(grams.bundle(ids[own], n[own]), want)
    grams.learn(np.unique(ids))
    assert np.array_equal(grams.bundle(ids[which == 0], n[which == 0]), Trigrams(64, 5).bundle(ids[which == 0], n[which == 0]))


def test_awkward_rows(spark):
    docs = awkward(spark, ["123 456", "...", "kato", "\u0301", "1\u0301 2"])
    profiles = fit(_labelled(spark, 100))
    rows = identify(docs, profiles).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].lang_pred for i in (0, 1, 2, 9, 10)] == [UNDETERMINED] * 5 and by[0].score == 0
    assert by[11].lang_pred == "aa" and by[12].lang_pred == by[13].lang_pred == UNDETERMINED
    carried = identify(docs, profiles, carry=docs.columns)
    assert carried.columns == [*docs.columns, "lang_pred", "score"] and carried.count() == docs.count()
    with pytest.raises(ValueError):
        identify(docs.selectExpr("*", "1 AS score"), profiles, carry=["doc_id", "text", "score"])
    clash = identify(docs.selectExpr("*", "1 AS score", "2 AS `a.b`"), profiles, carry=["text", "score", "a.b"], names=("p", "q"))
    assert clash.columns == ["text", "score", "a.b", "p", "q"] and {(r.score, r["a.b"]) for r in clash.collect()} == {(1, 2)}
    empty = spark.createDataFrame([], SCHEMA)
    nothing = fit(empty)
    assert nothing.languages == [] and identify(empty, nothing).count() == 0
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {UNDETERMINED}


def test_floor_parts_labelled_texts_from_noise(spark):
    docs = _labelled(spark)
    profiles = fit(docs)
    floor = score_floor(docs, profiles)
    own = identify(docs, profiles).collect()
    rng = random.Random(4)
    noise = spark.createDataFrame([(i, "".join(rng.choices("qxjvyzфждшюя", k=80)), None, None, None) for i in range(30)], SCHEMA)
    assert 0 < floor <= 0.51 * max(r.score for r in own) and all(r.score >= floor for r in own)
    assert all(r.score < floor for r in identify(noise, profiles).collect())
    assert score_floor(docs.where("false"), profiles) == 0


def test_floor_scores_every_labelled_text(spark, monkeypatch):
    from tidewater.llm import langid

    seen = []

    def counted(docs, profiles, doc_id):
        seen.append(docs.count())
        return docs.limit(5).selectExpr("lang AS doc_id", "lang AS lang_pred", "0.5D AS score")

    monkeypatch.setattr(langid, "identify", counted)
    docs = spark.range(30_000).selectExpr("concat('text ', id) AS text", "'aa' AS lang")
    assert score_floor(docs, langid.Profiles(["aa"], langid.np.zeros((1, 8)))) == 0.25 and seen == [30_000]
