"""Vectorised work on the bytes of Arrow string columns, for use inside tasks.

A batch of texts is seen as one byte buffer with document offsets; words, hashes and sums are then
computed for the whole buffer with numpy, without a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Separators of words: space and \x09-\x0D.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Texts of a batch are worked on in slabs of about so many bytes, which bounds the memory of a task.
SLAB_BYTES = 4 << 20

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64; kept between calls."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 2 * len(_powers[kind]), 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slabs(column: pa.Array, limit: int = SLAB_BYTES):
    """Yield (first row, bytes, offsets) of consecutive rows with about ``limit`` bytes; a longer text is a slab of its own."""
    data, at = string_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; a word is a longest run without separators in one text."""
    return runs(~_SEPARATOR[data], at)


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every longest run of marked bytes that lies in one document."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first = np.empty(len(inside) + 1, bool)
    first[0], first[-1] = inside[0], False
    first[1:-1] = inside[1:] & ~inside[:-1]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(inside))]
    first[edges] = inside[edges]
    last = np.empty(len(inside), bool)
    last[-1] = inside[-1]
    last[:-1] = inside[:-1] & ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first[:-1]), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte codes modulo 2**64, finalised."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power("up", len(data)), out=total[1:])
    value = (total[end] - total[start]) * _power("down", len(data) + 1)[start]
    return mix64(value ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def group_sums(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by group modulo 2**64 (each group with under 2**21 values)."""
    low = np.bincount(group, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(group, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))
