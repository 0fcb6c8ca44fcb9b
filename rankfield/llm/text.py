"""Words and hashes of whole Arrow text columns, as numpy arrays over the raw UTF-8 bytes.

Everything works on slices of a few megabytes, so a task's memory follows the longest single text, not
the batch. Null texts are empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: Bytes of a word: anything but ASCII white space.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, for exponents below n. Only those that a slice needs are kept."""
    size = max(n, SLICE_BYTES + 1)
    if size > SLICE_BYTES + 1 or not _powers:
        made = []
        for base in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            made.append(np.multiply.accumulate(run))
        if size > SLICE_BYTES + 1:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values in them."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    first = int(offsets[0]) if len(offsets) else 0
    buffer = column.buffers()[2]
    size = int(offsets[-1]) - first
    data = np.frombuffer(buffer, np.uint8, size, first) if size else np.empty(0, np.uint8)
    return data, offsets - first


def slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in runs whose texts have about ``limit`` bytes (or one long text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[name]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        release()


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share a machine with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """The words of a column: first and past-the-last byte, row, and a 64-bit hash of the bytes of each."""

    def __init__(self, column: pa.Array, member: np.ndarray = PLAIN, lower: bool = False) -> None:
        data, offsets = raw(column)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = member[self.data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[(offsets > 0) & (offsets < len(data))]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.rows = len(offsets) - 1
        #: Words of each row, and of all rows before it.
        self.count = np.bincount(self.row, minlength=self.rows) if self.rows else np.empty(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count))).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix(self.data), self.start, self.end)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: ``prefix(d)[j] - prefix(d)[i]`` belongs to the bytes from i to j."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(running))
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))


def grams(hashes: np.ndarray, row: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at i, i + gaps[0], i + gaps[1], ... for each i whose words are all in one row, and those i."""
    last = gaps[-1] if gaps else 0
    n = len(hashes) - last
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(row[:n] == row[last:])
    out = hashes[at]
    for gap in gaps:
        out = mix(out * BASE + hashes[at + gap] + np.uint64(gap))
    return out, at
