"""Words, word hashes and shingles of whole Arrow text columns, as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D (`[^\\x20\\x09-\\x0D]+`).
Those six separators are single bytes in UTF-8, so words are found in the
column's own buffer, without a Python string for each. Words never span two rows.
Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
BYTE_BASE = _U(0x9E3779B97F4A7C15)
WORD_BASE = _U(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes of text that are turned into arrays at once (a longer text is taken whole).
SLICE_BYTES = 900_000


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n at least; base is odd."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, base, dtype=np.uint64)
        up[0] = 1
        down = np.full(size, _U(pow(int(base), -1, 1 << 64)), dtype=np.uint64)
        down[0] = 1
        held = _powers[int(base)] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return held


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, one for each seed."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """The words of some rows, in order. Offsets are bytes in `data`."""

    data: np.ndarray
    first_byte: np.ndarray  # of each row, and the end of the last
    start: np.ndarray
    end: np.ndarray
    first_word: np.ndarray  # of each row, and the end of the last

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first_word)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first_word) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64 bits of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(BYTE_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + _U(1)) * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive items of words; len(words) - n + 1 of them, rows not told apart."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """The words of a string column; lower: A-Z count as a-z."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(offsets) else np.zeros(0, dtype=np.uint8)
    first_byte = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = ~SEPARATORS[data]
    cut = np.unique(first_byte[1:-1])
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = before[-1] = False
    if len(data):
        before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[: len(data)] = inside
    edge = before != after
    joined = cut[before[cut] & after[cut]]  # one row ends in a word and the next begins in one
    bounds = np.flatnonzero(edge)
    if len(joined):
        bounds = np.sort(np.concatenate([bounds, joined, joined]), kind="stable")
    start, end = bounds[0::2], bounds[1::2]
    return Words(data, first_byte, start, end, np.searchsorted(start, first_byte))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes of text each."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).cast(pa.int64()))
    group = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
