"""Words of whole texts as arrays: one pass over the bytes of an Arrow batch, without a Python object a word.

All word classes used here hold or exclude every byte from 0x80 up, so bytes of UTF-8 decide as characters do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone, whole.
CHUNK_BYTES = 4 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(of) -> np.ndarray:
    """256 booleans: whether the byte, lower-cased, is part of a word."""
    return np.array([of(int(LOWER[b])) for b in range(256)])


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: ``[^\x20\x09-\x0D]+``.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets of each text in them; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold up to CHUNK_BYTES, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """starts, ends: places of the words in ``data``; doc: their row; first: where each row's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data = LOWER[data]
        inside = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # texts end words
        prev, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        prev[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~prev | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.inside = inside
        self.first = np.searchsorted(self.starts, offsets)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        kept = self.data[self.inside]
        begins = np.cumsum(length) - length
        place = np.arange(len(kept)) - np.repeat(begins, length)
        powers = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
        sums = np.add.reduceat(_BYTE[kept] * powers[place], begins)
        return mixed(sums + length.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()
