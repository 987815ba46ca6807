from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from helpers import SCHEMA, awkward, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm.packing import added_tokens, assign, default_vocabulary, pack, token_ids


def _reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_every_id_lies_in_one_piece(spark):
    docs = awkward(spark, ["plain text " * 900, "don't <|endoftext|> 123,456\n\n\tx"])
    got = pack(docs, with_ids=True, block_tokens=5000, added=added_tokens()).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for key, rows in pieces.items():
        want = sorted(tuple(_reference_ids(t)) for t in texts[key])
        rest = sorted(rows, key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in rows) == sum(map(len, want))
        if len(want) == 1:
            assert tuple(i for r in rest for i in r.ids) == want[0]
            assert [r.start for r in rest] == [sum(x.length for x in rest[:k]) for k in range(len(rest))]
            assert {r.doc_tokens for r in rest} == {len(want[0])}
    assert set(pieces) == set(texts)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert sum(r.length for r in rows) <= 2048


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_little_padding(spark):
    docs = documents(spark, [f"word{i} " * (20 + i % 700) for i in range(300)]).coalesce(1)
    got = pack(docs).collect()
    assert sum(r.length for r in got) > 0.995 * 2048 * len({r.sequence_id for r in got})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40))
def test_assign_covers_each_document_once(lengths):
    pieces = assign(np.array(lengths, np.int64), 64)
    for i, n in enumerate(lengths):
        own = sorted((s, m) for d, s, m, _, _ in pieces if d == i)
        assert own[0][0] == 0 and sum(m for _, m in own) == n
        assert all(a + m == b for (a, m), (b, _) in zip(own, own[1:]))
    assert len({q for *_, q, _ in pieces}) <= sum(lengths) // 64 + 1 + sum(n >= 64 for n in lengths)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(20, 900, 400)
    cost = defaultdict(float)
    for _, _, n, q, _ in assign(lengths, 2048):
        cost[q] += n + n * n / 2048
    naive = [sum(n + n * n / 2048 for n in lengths[i : i + 4]) for i in range(0, 400, 4)]
    assert np.std(list(cost.values())[:-1]) < np.std(naive)


def test_queries_take_added_tokens_as_the_json_form_does(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tidewater.llm.packing import op1_packing

    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>  y <|endoftext|><|endoftext|>\n", "<|endoftext| >", "plain"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    json_form = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: zlib.crc32(np.array([*e.ids, 1], "<u4").tobytes()) for i, e in enumerate(json_form.encode_batch(texts, add_special_tokens=False))}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for got in (op1_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.ids_crc32 for r in got.collect()} == want


def test_very_long_runs_have_the_ids_of_the_whole_text(spark):
    n = 5_000_000
    texts = [" " * n, "\n" * n, "ab" * (n // 2), "!?" * (n // 2), "x" + " " * n + "y \u2003 z", "a" + "\r\n" * (n // 2) + "<|endoftext|>" + "\u3000" * 1_200_000 + "b  c", "\t" * 1_100_000 + "\x1c" + " \x85" * 600_000]
    for text in texts:
        assert np.array_equal(token_ids(default_vocabulary(), added_tokens(), text, 1), _reference_ids(text))
    got = pack(documents(spark, texts[4:5]), added=added_tokens()).agg({"length": "sum"}).first()[0]
    assert got == len(_reference_ids(texts[4]))
