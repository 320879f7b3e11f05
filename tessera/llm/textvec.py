"""Vectorised work on the UTF-8 bytes of many texts at once (numpy over Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Arrays of 8 bytes a byte of text are made for so many bytes at a time, or for one longer text.
CHUNK_BYTES = 512 << 10
_STEP = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse below ``_STEP``, made once a worker."""
    if not _TABLES:
        _TABLES.extend((_powers(_BASE, _STEP), _powers(_INVERSE, _STEP)))
    return _TABLES


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the buffer.

    The power of a place is that of its step times that within the step, so the tables
    stay small however long a text is.
    """
    power, inverse = _tables()
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    for k, lo in enumerate(range(0, len(buf), _STEP)):
        part = _BYTE[buf[lo : lo + _STEP]]
        part *= power[: len(part)]
        if k:
            part *= np.uint64(pow(_BASE, lo, 1 << 64))
        np.cumsum(part, out=total[lo + 1 : lo + 1 + len(part)])
        if k:
            total[lo + 1 : lo + 1 + len(part)] += total[lo]
    if len(buf) <= _STEP:
        back = inverse[np.minimum(starts, _STEP - 1)]
    else:
        steps = np.array([pow(_INVERSE, lo, 1 << 64) for lo in range(0, len(buf) + 1, _STEP)], np.uint64)
        back = inverse[starts % _STEP] * steps[starts // _STEP]
    return mix((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and their count) of the runs without gap bytes (ASCII white space).

    Words end at the end of their text.
    """
    solid = ~gap[buf]
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)
