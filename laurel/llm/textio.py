"""Arrow text columns as numpy arrays: slices of bounded size, words, and word hashes.

Everything works on a slice of about a megabyte of UTF-8 at a time (one longer text is a slice
of its own), so memory is bounded by the longest text and not by the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: Bytes that are not ASCII white space (9 to 13 and 32).
NOT_SPACE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
#: Bytes of 0-9, A-Z, a-z and beyond ASCII.
ALNUM = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def one_thread() -> None:
    """One thread for matrix products in this process: its neighbours fill the other cores, and small products lose by more threads."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, since a worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch slice, bytes of its texts one after the other, offsets of the texts); a null text is empty."""
    for batch in batches:
        texts = batch.column(column)
        if texts.null_count:
            texts = texts.fill_null("")
        if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
            kind = np.int64
        else:
            kind = np.int32
        _, bounds, data = texts.buffers()
        offsets = np.frombuffer(bounds, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def word_bounds(buf: np.ndarray, offsets: np.ndarray, inside_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in `inside_of`, and the index of each text's first run (one more at the end)."""
    inside = inside_of[buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for factor in (_BASE, inverse):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers, _inverse = made
    return _powers, _inverse


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of bytes; equal bytes have equal hashes wherever they stand."""
    powers, inverse = _tables(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all `width` consecutive word hashes (also across texts; the caller masks those)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n] + np.uint64(k + 1))
    return out
