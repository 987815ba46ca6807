"""Vectorised text helpers that run inside Spark tasks.

Every helper takes one Arrow batch worth of texts and works on the whole batch
with numpy, so that Python never loops over words.  Hashes are 64-bit
polynomials over bytes (words) and over mixed word hashes (word windows); both
wrap modulo 2**64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1

#: Bytes that end a word: space and the ASCII controls 0x09-0x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The same with ASCII punctuation: everything up to 0x7F but letters and digits.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept per process, grown by doubling)."""
    up, down = _POWERS.get(base, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    inverse = pow(base, -1, 1 << 64)
    while len(up) < n:
        k = len(up)
        up = np.concatenate([up, up * np.uint64(pow(base, k, 1 << 64))])
        down = np.concatenate([down, down * np.uint64(pow(inverse, k, 1 << 64))])
    _POWERS[base] = (up, down)
    return up[:n], down[:n]


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum(values[j] * base**(j - start)) for start <= j < end, modulo 2**64."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """The words of a batch of documents, flattened.

    ``data`` holds all bytes; word ``i`` is ``data[starts[i]:ends[i]]``; the words of
    document ``d`` are those from ``first[d]`` up to ``first[d + 1]``.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def doc_of(self) -> np.ndarray:
        """The document's position in the batch, for every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False, marks: bool = False) -> Words:
    """Split every text of the column at ASCII white space and hash each word.

    ``lower`` folds A-Z only; with ``marks`` all ASCII controls and punctuation part
    words too.  A null or blank text has no words.
    """
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    word = ~(_IS_MARK if marks else _IS_SPACE)[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False  # a row's first byte starts a word whatever stood before it
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(word & ~after) + 1
    hashes = mix(_range_hash(data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASE) + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes)


def windows_of(words: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash every run of ``size`` words that lies in one document.

    Returns the hashes and, for each, the index of its first word.  Different
    ``salt`` values give independent hash functions.
    """
    n = np.maximum(np.diff(words.first) - size + 1, 0)
    at = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return window_hashes(words.hashes, at, size, salt), at


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash ``hashes[i:i + size]`` for each start ``i`` in ``at``."""
    values = mix(hashes ^ np.uint64(salt * 0xD6E8FEB86659FD93 & _MASK)) if salt else hashes
    return mix(_range_hash(values, at, at + size, _WORD_BASE) + np.uint64(salt))
