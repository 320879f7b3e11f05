"""Content-defined anchors of fixed-length byte windows (winnowing, public algorithm)."""

from __future__ import annotations

import numpy as np

from .textvec import _BYTE, mix

GRAM = 32
_STEP = [np.uint64(pow(0xD1342543DE82EF95, 1 << k, 1 << 64)) for k in range(6)]


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) at each place of the buffer."""
    h = _BYTE[buf]
    size = 1
    for k in range(gram.bit_length() - 1):
        h = h[:-size] * _STEP[k] + h[size:]
        size *= 2
    return mix(h)


PIECE = 1 << 20
_LOW = (1 << 26) - 1


def window_anchors(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last window start, gram hash) of the windows of ``length`` bytes.

    A window's anchor is the place of its least gram hash, the first of ties. The choice
    depends on the window's bytes alone, so equal windows have their anchors at the same
    distance. Very long texts are taken in pieces; an anchor may then come twice.
    """
    out = []
    for lo in range(0, max(len(buf) - length + 1, 0), PIECE):
        part = buf[lo : lo + PIECE + length - 1]
        n = len(part) - length + 1
        grams = gram_hashes(part)
        best = (grams & np.uint64(((1 << 64) - 1) ^ _LOW)) | np.arange(len(grams), dtype=np.uint64)
        width, size = length - GRAM + 1, 1
        while size * 2 <= width:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if size < width:
            best = np.minimum(best[:n], best[width - size : width - size + n])
        at = (best[:n] & np.uint64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], n) - 1
        out.append((at[first] + lo, first + lo, last + lo, grams[at[first]]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
