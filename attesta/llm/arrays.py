"""Numpy helpers that the operators use inside Arrow tasks."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Texts of one step inside a task: bounds a worker's memory whatever the batch size.
STEP_BYTES = 8 << 20


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None
_LAST = [0.0]


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task holds little; at most five times a second."""
    if _LIBC and time.monotonic() - _LAST[0] > 0.2:
        pa.default_memory_pool().release_unused()
        _LIBC.malloc_trim(0)
        _LAST[0] = time.monotonic()


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives memory back at its end."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _LAST[0] = 0.0
        give_back()

    return mapped


def lean_group(run: Callable) -> Callable:
    """The same for applyInArrow."""

    def grouped(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    return grouped


def lean_cogroup(run: Callable) -> Callable:
    """The same for two tables."""

    def cogrouped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return cogrouped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit (murmur3's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix32(x: np.ndarray) -> np.ndarray:
    """The same for uint32, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text (or array<int>) column holds about `limit` bytes, one row at least."""
    a = batch.column(batch.schema.get_field_index(column))
    lengths = pa.compute.multiply(pa.compute.list_value_length(a), 4) if pa.types.is_list(a.type) else pa.compute.binary_length(a)
    sizes = np.fromiter((0 if x is None else x for x in lengths.to_pylist()), np.int64, len(a))
    ends, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            ends.append(i)
            start, total = i, 0
        total += n
    at = 0
    for end in [*ends, len(a)]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def text_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and n + 1 offsets; nulls are empty."""
    a = pa.compute.fill_null(a.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], np.int64, a.offset + len(a) + 1)[a.offset:]
    data = a.buffers()[2]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[offsets[0]:offsets[-1]], offsets - offsets[0]


def lower_ascii(b: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    up = (b - np.uint8(65)) < 26
    return b + (up.view(np.uint8) << 5)


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
