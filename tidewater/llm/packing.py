"""Cost-balanced packing (operator 1).

A task tokenises its rows and packs them in blocks: every run of ``capacity`` tokens
of a long document fills a sequence, what is left of each document is assigned, longest
first, to the sequence of the lowest attention cost that still has room.  Nothing is
shuffled: a block is packed where its rows were read, so padding is at most one
sequence per block.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import column, short_batches, slices, table

#: Attention cost of n tokens of one document: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

_ENCODERS: dict = {}


def default_vocabulary() -> str:
    """The byte-level BPE of 50k tokens, in its rank form: the ids of the JSON form but for its added tokens (``added``)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The added tokens of the vocabulary's JSON form, which ``tokenizers`` matches in plain text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def encoder(vocabulary: str, added: dict[str, int] | None = None, whole: bool = False):
    """The tokenizer of a rank file; strings of special tokens are ordinary text to it, but for those ``added``.  To a ``whole`` one a text is one piece."""
    known = (vocabulary, whole, *sorted((added or {}).items()))
    if known not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[known] = tiktoken.Encoding("byte_bpe", pat_str=r"(?s:.+)" if whole else public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {})
    return _ENCODERS[known]


#: White space as the vocabulary's pattern has it, in runs that its look-ahead cannot walk back through.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def _in_parts(encode, vocabulary: str, added: dict[str, int] | None, text: str) -> np.ndarray:
    """The ids of a text with very long runs of white space, the runs apart.

    The pattern makes one piece of a run, without its last character if something follows
    in the text that is no added token; so the parts have the pieces of the whole.
    """
    out, at = [], 0
    for run in _RUN.finditer(text):
        rest = run.end() < len(text) and not text.startswith(tuple(added or ()), run.end())
        out.append(encode.encode_to_numpy(text[at : run.start()], allowed_special="all", disallowed_special=()))
        at = run.end() - rest
        out.append(encoder(vocabulary, None, whole=True).encode_to_numpy(text[run.start() : at], disallowed_special=()))
    out.append(encode.encode_to_numpy(text[at:], allowed_special="all", disallowed_special=()))
    return np.concatenate(out)


def token_ids(vocabulary: str, added: dict[str, int] | None, text: str | None, end: int) -> np.ndarray:
    """A document's ids followed by ``end``; a null text has the end alone."""
    encode = encoder(vocabulary, added)
    try:
        ids = encode.encode_to_numpy(text, allowed_special="all", disallowed_special=()) if text else np.zeros(0, np.uint32)
    except ValueError:  # the pattern ran out of stack
        ids = _in_parts(encode, vocabulary, added, text)
    return np.append(ids, np.uint32(end)).astype("<u4")


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of ``lengths`` tokens: pieces (document, start, length, sequence, offset).

    Whole runs of ``capacity`` tokens fill sequences of their own.  The remainders are
    taken in descending order; each goes to the cheapest sequence that can hold it
    whole, or else is cut into the cheapest ones that have room.  So few sequences are
    opened as the tokens need.
    """
    pieces, sequence = [], 0
    for i, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((i, start, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    count = -(-int(rest.sum()) // capacity)
    room, cost = np.full(count, capacity), np.zeros(count)
    for i in np.argsort(-rest, kind="stable"):
        left = int(rest[i])
        start = int(lengths[i]) - left
        while left:
            fits = room >= left
            at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            n = min(left, int(room[at]))
            pieces.append((int(i), start, n, sequence + at, capacity - int(room[at])))
            room[at] -= n
            cost[at] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return pieces


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 1, vocabulary: str | None = None, block_tokens: int = 1 << 20, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    ``start`` counts the document's ids before the piece; ``offset`` is the piece's place
    in its sequence; pieces of a sequence lie without gaps from 0.  A null or empty text
    is a document of the end token alone; null ids and repeated rows are packed as they
    are; an empty table gives no rows; further columns are ignored.  A task holds one
    block of ``block_tokens`` tokens, or its longest document.  Strings of ``added`` become
    their ids wherever they stand in a text; without it they are ordinary text.  A text may be of
    any length and of one character throughout: a run of white space that the pattern cannot
    walk back through is encoded apart, with the same ids.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids array<int>" if with_ids else ""

    def packed(block: list, first: int) -> pa.RecordBatch:
        lengths = np.array([len(ids) for _, ids in block])
        pieces = assign(lengths, capacity)
        which, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        cut = [block[i][1][s : s + n] for i, s, n in zip(which, start, length)]
        columns = [
            pa.array([block[i][0] for i in which], pa.int64()),
            start,
            length,
            np.array([zlib.crc32(c.tobytes()) for c in cut], np.int64),
            lengths[which].astype(np.int64),
            first + sequence,
            offset,
        ]
        if with_ids:
            columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokens = [], 0
        first = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text"):
            for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                block.append((key, ids := token_ids(vocabulary, added, body, end)))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield packed(block, first)
                    first += tokens // capacity + 1
                    block, tokens = [], 0
        if block:
            yield packed(block, first)

    return short_batches(docs).select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text")).mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), added=added_tokens())
