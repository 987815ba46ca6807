from __future__ import annotations

import random

import pytest
from helpers import SCHEMA, awkward, documents

from tidewater.llm.lines import NEAR_FROM, dedup_lines, duplicate_lines


def _edit_one(rng, line):
    p, c = rng.randrange(len(line)), rng.choice("xyzß😀")
    return rng.choice([line[:p] + c + line[p + 1 :], line[:p] + line[p + 1 :], line[:p] + c + line[p:], line[:p] + line[p + 1] + line[p] + line[p + 2 :] if p + 1 < len(line) else line])


def _within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def _brute(docs):
    lines = [(d, i, x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= NEAR_FROM or x.strip(" \t\n\v\f\r")]
    lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    near = lambda x, y: x == y or (min(len(x), len(y)) >= NEAR_FROM and _within_one(x, y))
    return {(d, i) for k, (d, i, x) in enumerate(lines) if any(near(x, y) for _, _, y in lines[:k])}


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abc de", k=rng.choice([20, 21, 37, 64, 90, 300, 3000]))) for _ in range(25)]
    base += [f"the same long template with number {i % 7} and a tail that never changes" for i in range(12)]
    base += ["Les.", "}", "", " \t ", "Chapter 2", "Chapter 3", " " * 25]
    texts = []
    for _ in range(60):
        picked = [rng.choice(base) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join(_edit_one(rng, x) if x and rng.random() < 0.5 else x for x in picked))
    docs = documents(spark, texts)
    got = {(r.doc_id, r.line_no) for r in duplicate_lines(docs).collect()}
    assert got == _brute(list(enumerate(texts)))
    kept = {r.doc_id: r for r in dedup_lines(docs).collect()}
    for i, t in enumerate(texts):
        assert kept[i].text == "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in got)
        assert kept[i].removed_lines == sum(d == i for d, _ in got)


def test_awkward_rows(spark):
    docs = awkward(spark, ["a line of more than twenty characters\nshort", "a line of more than twenty characterS\n\nshort"])
    rows = dedup_lines(docs).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, r.text) for r in rows}
    assert (9, "a line of more than twenty characters\nshort") in by and (10, "") in by
    assert any(r.text is None for r in rows) and {r.key for r in rows} == {"x"}
    with pytest.raises(ValueError):
        dedup_lines(docs.selectExpr("*", "1 AS removed_lines"))


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python(spark):
    plan = dedup_lines(documents(spark, ["x" * 30]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_are_carried(spark):
    names = ["_td_key", "_td_gone", "_td_row", "_td_may", "_td_word", "row", "doc", "gone", "id", "key", "lines", "a.b", "t`ick", "h"]
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    docs = documents(spark, ["one line\nand a footer", "two line\nand a footer", None]).selectExpr("*", *[f"'{i}' AS {n}" for i, n in enumerate(quoted)])
    rows = dedup_lines(docs).collect()
    assert sorted(r.text or "" for r in rows) == ["", "one line\nand a footer", "two line"]
    assert all(tuple(r)[5:-1] == tuple(str(i) for i in range(len(names))) for r in rows) and dedup_lines(docs).columns == [*docs.columns, "removed_lines"]
    with pytest.raises(ValueError):
        dedup_lines(docs.selectExpr("*", "1 AS Removed_Lines"))


def test_equal_short_lines_go(spark):
    texts = ["Les.\n\nfirst", "Les.\n\nother\n \t\n}", "Lес.\nLes\n}\n \t\n", "Les.", "a line of more than twenty characters\nLes.\nx", "a line of more than twenty characterS\nx"]
    rows = {r.doc_id: r for r in dedup_lines(documents(spark, texts)).collect()}
    assert [rows[i].text for i in range(6)] == ["Les.\n\nfirst", "\nother\n \t\n}", "Lес.\nLes\n \t\n", "", "a line of more than twenty characters\nx", ""]
    assert [rows[i].removed_lines for i in range(6)] == [0, 1, 1, 1, 1, 2]


def test_a_line_goes_from_its_own_text_only(spark):
    footer = "a footer that stands in more than one text"
    rows = [(1, footer), (7, f"some first line of the one text\n{footer}"), (7, "another first line altogether\na line that no other text has"), (None, f"{footer}\nnothing else is like this line"), (None, "a line of a text that has no id\nand here is yet another one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.text, r.removed_lines) for r in dedup_lines(docs).collect())
    # a null id comes first, so its footer stays
    want = [(1, "", 1), (7, "some first line of the one text", 1), (7, rows[2][1], 0), (None, rows[3][1], 0), (None, rows[4][1], 0)]
    assert got == sorted((str(i), t, n) for i, t, n in want)
