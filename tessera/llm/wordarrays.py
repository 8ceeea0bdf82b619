"""Vectorised word and character views over batches of texts.

The operators that read every word of every document run inside Spark tasks on
Arrow batches.  These helpers turn a slice of an Arrow string column into flat
numpy arrays (one entry per word) without a Python loop over rows or words, in
pieces of bounded size, so that a task's memory does not depend on how many or
how long documents its partition holds, except that one text is never split.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``.  A word
is known by a 64-bit polynomial hash of its bytes, finished with a mixing step;
two different words collide with probability about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 steps) on uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the base and of its inverse, grown on demand in each worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full(n, _BASE)
            steps[0] = 1
            cls.up = np.multiply.accumulate(steps)
            steps[1:] = _BASE_INV
            cls.down = np.multiply.accumulate(steps)
        return cls.up, cls.down


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; values are uint64, spans may overlap."""
    up, down = _Powers.upto(max(len(values), CHUNK_BYTES) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def text_chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string array: (first row, bytes, row offsets into these bytes).

    A slice has at most max_bytes bytes unless a single text is longer.  Null
    texts count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@dataclass
class Words:
    """The words of a slice of documents, in order."""

    first_row: int
    n_rows: int
    hashes: np.ndarray  # uint64, one per word
    rows: np.ndarray  # the document of each word, counted from the slice's first
    per_row: np.ndarray  # words of each document


def words_of(texts: pa.Array, lower: bool = False, max_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column; lower folds A-Z only."""
    for first, data, offsets in text_chunks(texts, max_bytes):
        n = len(offsets) - 1
        if lower:
            data = LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[offsets] = True  # a document's end closes a word
        change = inside[1:] & (~inside[:-1] | before)
        starts = np.flatnonzero(change)
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | before))
        hashes = span_hashes(BYTE_VALUE[data], starts, ends)
        per_row = np.diff(np.searchsorted(starts, offsets))
        yield Words(first, n, hashes, np.repeat(np.arange(n), per_row), per_row)
