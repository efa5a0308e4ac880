"""Whole texts of an Arrow batch as flat numpy arrays: bytes, words and 64-bit span hashes.

Spark hands a string column to Python as one UTF-8 buffer with offsets. These helpers work
on that buffer directly, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of BASE and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            table, filled = np.empty(size, np.uint64), 1
            table[0] = 1
            while filled < size:
                step = np.uint64(pow(base, filled, 1 << 64))
                table[filled : 2 * filled] = table[:filled] * step
                filled *= 2
            _POWERS[k] = table
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; element i covers data[:i]."""
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = data
    out[1:] += np.uint64(1)
    out[1:] *= _powers(max(1, len(data)))[0][: len(data)]
    np.cumsum(out[1:], out=out[1:])
    return out


def hash_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end); equal bytes give equal hashes anywhere."""
    inverse = _powers(max(1, len(prefix)))[1]
    return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the maximal runs of bytes other than space and 0x09-0x0D.

    ``first[d]`` is the index of document d's first word; its last element is the word count.
    A document's end also ends a word.
    """
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][(offsets[:-1] < n) & (offsets[:-1] > 0)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(~inside), n)
    ends = stops[np.searchsorted(stops, starts)]
    first = np.searchsorted(starts, offsets)
    limit = np.repeat(offsets[1:], np.diff(first))
    return starts, np.minimum(ends, limit), first


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system, so that a reused worker does not keep its peak."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Text bytes worked on at once. Each makes some ten arrays of 8 bytes a text byte; with one less than a
#: power of two the running sums of a slice, one longer, fit in a table of powers of that size.
SLICE = (1 << 20) - 1


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes; a longer text has a batch of its own."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
                yield batch.slice(at, stop - at)
                at = stop
            give_back()


def strings(values: list[bytes] | np.ndarray) -> pa.Array:
    return pa.array(values, pa.binary())
