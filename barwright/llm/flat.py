"""Whole texts of an Arrow batch as flat numpy arrays: bytes, word bounds, 64-bit word hashes.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return. These are
ASCII, so bytes of UTF-8 can be cut there. A batch is worked on in parts of about ``PART_BYTES``, so that the arrays of a
task stay small; a longer text is a part of its own and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PART_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = 0xD6E8FEB86659FD93
_GRAM_INVERSE = pow(_GRAM, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept until the task ends; the longest run so far sets the size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(n - 1, 1).bit_length(), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def released(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives its memory back when it ends: Python workers live on, and what each stage leaves in them adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library keeps freed pages otherwise
                trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: int) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(inverse, len(prefix))[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Flat:
    """Texts ``0..n-1``: ``data[offsets[i]:offsets[i + 1]]`` are the bytes of text i."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def byte_prefix(self, lower: bool) -> np.ndarray:
        """Prefix sums from which ``range_hashes`` takes the hash of any range of bytes."""
        values = _BYTE[LOWER[self.data] if lower else self.data]
        values *= powers(_BASE, len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=out[1:])
        return out

    def words(self, lower: bool = False) -> Words:
        data, offsets = self.data, self.offsets
        gap = SEPARATOR[data]
        first, last = ~gap, ~gap
        first[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        full = offsets[:-1] < offsets[1:]
        first[offsets[:-1][full]] = ~gap[offsets[:-1][full]]
        last[offsets[1:][full] - 1] = ~gap[offsets[1:][full] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = range_hashes(self.byte_prefix(lower), starts, ends, _INVERSE)
        return Words(starts, ends, hashes, np.searchsorted(starts, offsets))

    def byte_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        return range_hashes(self.byte_prefix(lower), starts, ends, _INVERSE)


@dataclass
class Words:
    """Words of all texts in order; those of text i are ``bounds[i]:bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def prefix(self) -> np.ndarray:
        values = self.hashes * powers(_GRAM, len(self.hashes))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=out[1:])
        return out

    def sequence_hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the word sequences ``starts[i]:ends[i]``."""
        return range_hashes(self.prefix() if prefix is None else prefix, starts, ends, _GRAM_INVERSE)

    def gram_starts(self, k: int) -> np.ndarray:
        """Numbers of the words at which k words of one text start."""
        here = np.ones(len(self.hashes), bool)
        for i in range(1, k):
            ends = self.bounds[1:] - i
            here[ends[ends >= self.bounds[:-1]]] = False
        return np.flatnonzero(here)


def flat(texts: pa.Array) -> Flat:
    """A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return Flat(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return Flat(data, offsets - offsets[0])


def parts(batch: pa.RecordBatch, column: str = "text", limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of a column, at least one row each."""
    ends = flat(batch.column(column)).offsets[1:]
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
