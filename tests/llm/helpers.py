"""Small documents with every awkward case, and plain-Python forms of the contracts."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, start: int = 0):
    rows = [(start + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark, extra: list[str | None] = ()):
    """Nulls in any column, empty and blank texts, long texts, repeated rows, other columns of clashing names."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choices(vocabulary, k=6000))
    texts = [None, "", "  \n\t ", "one", "two words", long, long, long[200:], "é ü ß 漢字 😀 " * 8, *extra]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[3], (None, "no id " * 30, "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' AS key", "1 AS page", "2 AS n", "'y' AS component", "3 AS start", "'z' AS h", "7 AS line_no", "'c' AS counts")


def collected(df) -> dict:
    return {r[0]: r for r in df.collect()}
