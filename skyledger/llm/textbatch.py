"""Vectorised words over Arrow text columns.

Texts are never decoded to Python strings here: a column is walked in blocks of
whole rows, and words are found, hashed and re-joined on the UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Bytes of text handled at once (a longer row makes a block of its own).
BLOCK_BYTES = 1 << 19

#: Arrays of this many bytes go back to the system when they are freed.
RETURNED_BYTES = 1 << 20


def _return_freed_memory() -> None:
    """Holds glibc's mmap threshold where it is: left alone it rises to 32 MB, and a worker then keeps what its largest block took.

    Arrow's own pool would keep the largest batches in the same way, so a worker takes them from the system.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, RETURNED_BYTES)  # M_MMAP_THRESHOLD
    if TaskContext.get() is not None:
        pa.set_memory_pool(pa.system_memory_pool())


_return_freed_memory()

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)

_all = np.arange(256)
#: Words of anything but ASCII white space.
NOT_SPACE = ~((_all == 0x20) | ((_all >= 9) & (_all <= 13)))
#: Words of ASCII letters and digits and of everything beyond ASCII.
ALNUM = ((_all >= 48) & (_all <= 57)) | ((_all >= 65) & (_all <= 90)) | ((_all >= 97) & (_all <= 122)) | (_all >= 128)
#: A-Z to a-z, all else as it is.
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_BASE, inverse))
        return self.up, self.down


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a block: byte ranges in data, and each row's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.is_word = np.take(word_byte, data)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if n:
            before = np.empty(n, bool)
            before[0], before[1:] = False, self.is_word[:-1]
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, self.is_word[1:]
            self.start = np.flatnonzero(self.is_word & (~before | edge[:-1]))
            self.end = np.flatnonzero(self.is_word & (~after | edge[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.row = np.searchsorted(self.start, offsets)  # row r has words row[r]..row[r+1]
        self.n = len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), self.counts())

    def _sums(self) -> np.ndarray:
        if not hasattr(self, "_cum"):
            up, _ = _powers.get(len(self.data) + 1)
            self._cum = np.zeros(len(self.data) + 1, np.uint64)
            terms = np.take(_BYTE, self.data)
            terms *= up[: len(self.data)]
            np.cumsum(terms, out=self._cum[1:])
        return self._cum

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word's bytes, or of the given byte ranges."""
        start, end = (self.start, self.end) if start is None else (start, end)
        cum, (_, down) = self._sums(), _powers.get(len(self.data) + 1)
        return mix((cum[end] - cum[start]) * down[start] + (end - start).astype(np.uint64))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words joined by one space each, and every word's start and end in that."""
        length = self.end - self.start
        end = np.cumsum(length + 1) - 1
        out = np.full(int(end[-1]) if self.n else 0, 32, np.uint8)
        mask = np.ones(len(out), bool)
        mask[end[:-1]] = False
        out[mask] = self.data[self.is_word]
        return out.tobytes(), end - length, end


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : j + n]
    return mix(out)


def blocks(column: pa.Array, word_byte: np.ndarray, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of whole rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        part = data[offsets[first] : offsets[last]]
        yield first, last, Words(np.take(LOWER, part) if lower else part, offsets[first : last + 1] - offsets[first], word_byte)
        first = last


def doc_ids(column: pa.Array) -> np.ndarray:
    """int64, a null as the largest value."""
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


#: Stands for a null doc_id: it comes after every other.
NO_ID = (1 << 63) - 1
