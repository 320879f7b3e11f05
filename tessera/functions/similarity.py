"""String similarities that Spark lacks, for whole Arrow batches at a time.

Strings of up to 64 characters are compared bit-parallel with one machine word a pair,
all pairs of a batch in step (numpy); longer ones one by one on Python integers. Each
similarity is 0 for an empty side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

WORD = 64
NAMES = ("jaro_winkler", "ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "weighted_ratio")


# --- one pair --------------------------------------------------------------------------


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel on Python integers."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = v & places.get(c, 0)
        v = (v + m | v - m) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * lcs(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter string to a window of the longer one, cut ones at the edges too.

    A window moved by one place gains at most one common character, so places that
    cannot beat the best so far are passed over; the result is that of all windows.
    Of strings of one length each is the shorter one in turn. A best ratio of ``least`` or
    less may come out lower.
    """
    if len(a) > len(b):
        a, b = b, a
    best = _best_window(a, b, least)
    return max(best, _best_window(b, a, max(best, least))) if len(a) == len(b) and best < 100.0 else best


def _best_window(a: str, b: str, least: float) -> float:
    n, m = len(a), len(b)
    if not n:
        return 0.0 if b else 100.0
    found, bar, i = 0.0, least, 0
    while i <= m - n and bar < 100.0:
        common = lcs(a, b[i : i + n])
        found = max(found, 100.0 * 2 * common / (2 * n))
        bar = max(bar, found)
        i += max(1, int(bar * n / 100 - common))
    for edge in (lambda k: b[:k], lambda k: b[m - k :]):
        k = 1
        while k < n and bar < 100.0:
            common = lcs(a, edge(k))
            found = max(found, 100.0 * 2 * common / (n + k))
            bar = max(bar, found)
            k += max(1, int((bar * (n + k) / 200 - common) / (1 - bar / 200)))
    return found


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


# --- all pairs of a batch ------------------------------------------------------------------


class _Pairs:
    """Pairs of strings as matrices of codes, with the places of each code as bits."""

    def __init__(self, a: list[str], b: list[str]):
        self.x, self.y = self._matrix(a), self._matrix(b)
        self.chars = np.unique(self.x)
        self.rows = np.arange(len(a))

    @staticmethod
    def _matrix(strings: list[str]) -> np.ndarray:
        wide = max(map(len, strings), default=0) or 1
        return np.array(strings, f"<U{wide}").view(np.uint32).reshape(len(strings), wide)

    def codes(self, m: np.ndarray) -> np.ndarray:
        """Places in the alphabet of the first strings; its size for other characters and beyond the end."""
        at = np.minimum(np.searchsorted(self.chars, m), len(self.chars) - 1)
        return np.where((self.chars[at] == m) & (m != 0), at, len(self.chars))

    def places(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(self.chars) + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[self.rows, codes[:, i]] |= np.uint64(1 << i)
        out[:, -1] = 0
        return out


def _full(lengths: np.ndarray) -> np.ndarray:
    return np.where(lengths >= WORD, ~np.uint64(0), (np.uint64(1) << (lengths % WORD).astype(np.uint64)) - np.uint64(1))


def _apart(a: list[str], b: list[str], inside: Callable[[list[str], list[str]], np.ndarray], alone: Callable[[str, str], float], fits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    at = np.flatnonzero(fits)
    for lo in range(0, len(at), 4096):
        part = at[lo : lo + 4096].tolist()
        out[part] = inside([a[i] for i in part], [b[i] for i in part])
    for i in np.flatnonzero(~fits).tolist():
        out[i] = alone(a[i], b[i])
    return out


def _lcs_words(a: list[str], b: list[str]) -> np.ndarray:
    p = _Pairs(a, b)
    x, y = p.codes(p.x), p.codes(p.y)
    places, v = p.places(x), np.full(len(a), ~np.uint64(0))
    for j in range(y.shape[1]):
        u = v & places[p.rows, y[:, j]]
        v = (v + u) | (v - u)
    n = np.array([len(s) for s in a], np.int64)
    return n - np.bitwise_count(v & _full(n)).astype(np.int64)


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long = [x for x, _ in pairs], [y for _, y in pairs]
    return _apart(short, long, _lcs_words, lcs, np.array([len(x) <= WORD and len(y) <= 4 * WORD for x, y in pairs], bool))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(total > 0, 200.0 * common_lengths(a, b) / np.maximum(total, 1), 100.0)


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return ratios([" ".join(sorted(x.split())) for x in a], [" ".join(sorted(y.split())) for y in b])


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    both, left, right, sure = [], [], [], np.zeros(len(a))
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = set(s.split()), set(t.split())
        same = sorted(x & y)
        if not x or not y:
            sure[i] = -1
        elif same and (x <= y or y <= x):
            sure[i] = 1
        both.append(" ".join(same))
        left.append(" ".join([*same, *sorted(x - y)]))
        right.append(" ".join([*same, *sorted(y - x)]))
    # The common words begin both strings: that ratio follows from the lengths.
    n, p, q = (np.array([len(s) for s in c], np.float64) for c in (both, left, right))
    base = np.where(n > 0, np.maximum(200 * n / np.maximum(n + p, 1), 200 * n / np.maximum(n + q, 1)), 0.0)
    return np.where(sure < 0, 0.0, np.where(sure > 0, 100.0, np.maximum(base, ratios(left, right))))


#: Windows that are compared at a time.
WINDOWS = 1 << 16


def _windows(short: list[str], long: list[str]) -> np.ndarray:
    """Best ratios of the first strings to windows of the second ones, which are no shorter: all places in step."""
    p = _Pairs(short, long)
    n, m = (np.array([len(s) for s in c], np.int64) for c in (short, long))
    places, none = p.places(p.codes(p.x)), len(p.chars)
    y = np.concatenate([p.codes(p.y), np.full((len(short), p.x.shape[1]), none)], 1)
    pair = np.repeat(p.rows, m)
    start = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
    size, full, first = n[pair], _full(n), np.cumsum(m) - m
    v, best = np.full(len(pair), ~np.uint64(0)), np.zeros(len(short))
    for j in range(p.x.shape[1]):
        u = v & places[pair, np.where(j < size, y[pair, start + j], none)]
        v = (v + u) | (v - u)
        # The beginnings of the longer string.
        best = np.maximum(best, np.where(j + 1 < n, 200.0 * (n - np.bitwise_count(v[first] & full).astype(np.int64)) / (n + j + 1), 0.0))
    common = size - np.bitwise_count(v & full[pair]).astype(np.int64)
    # Windows that the end cuts are as long as what is left.
    return np.maximum(best, np.maximum.reduceat(200.0 * common / (size + np.minimum(size, m[pair] - start)), first))


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    n, m = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    fits = (n > 0) & (n <= WORD) & (m <= 4 * WORD)
    out = np.zeros(len(pairs))
    # Pairs of like lengths are compared together; of strings of one length each is the shorter one in turn.
    at = np.flatnonzero(fits)[np.lexsort((m[fits], n[fits]))]
    cuts = np.flatnonzero(np.diff(np.cumsum(m[at]) // WINDOWS, prepend=0)) if len(at) else at
    for part in np.split(at, cuts):
        if len(part):
            out[part] = _windows([pairs[i][0] for i in part.tolist()], [pairs[i][1] for i in part.tolist()])
    twice = np.flatnonzero(fits & (n == m))
    for lo in range(0, len(twice), 1024):
        part = twice[lo : lo + 1024]
        out[part] = np.maximum(out[part], _windows([pairs[i][1] for i in part.tolist()], [pairs[i][0] for i in part.tolist()]))
    for i in np.flatnonzero(~fits).tolist():
        out[i] = partial_ratio(*pairs[i])
    return out


def partial_token_ratios(a: list[str], b: list[str]) -> np.ndarray:
    words = [(x.split(), y.split()) for x, y in zip(a, b, strict=True)]
    apart = np.array([not set(x) & set(y) for x, y in words], bool)
    out = np.full(len(words), 100.0)
    some = [words[i] for i in np.flatnonzero(apart).tolist()]
    every = partial_ratios([" ".join(sorted(x)) for x, _ in some], [" ".join(sorted(y)) for _, y in some])
    # Only repeated words make the distinct ones another text.
    again = np.array([len(set(x)) < len(x) or len(set(y)) < len(y) for x, y in some], bool)
    own = [some[i] for i in np.flatnonzero(again).tolist()]
    every[again] = np.maximum(every[again], partial_ratios([" ".join(sorted(set(x))) for x, _ in own], [" ".join(sorted(set(y))) for _, y in own]))
    out[apart] = every
    return out


def weighted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    n, m = (np.array([len(s) for s in c], np.float64) for c in (a, b))
    spread = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    plain = ratios(a, b)
    far = np.flatnonzero((spread >= 1.5) & (n > 0) & (m > 0))
    near = np.flatnonzero(spread < 1.5)
    out = plain.copy()
    some = lambda c, at: [c[i] for i in at.tolist()]
    x, y = some(a, near), some(b, near)
    out[near] = np.maximum(plain[near], 0.95 * np.maximum(token_sort_ratios(x, y), token_set_ratios(x, y)))
    x, y = some(a, far), some(b, far)
    scale = np.where(spread[far] <= 8, 0.9, 0.6)
    out[far] = np.maximum(np.maximum(plain[far], 0.95 * scale * partial_token_ratios(x, y)), scale * partial_ratios(x, y))
    return np.where((n > 0) & (m > 0), out, 0.0)


def _winkler(jaro: np.ndarray | float, prefix: np.ndarray | int) -> np.ndarray | float:
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winkler(a: str, b: str) -> float:
    """Of strings that are longer than a machine word."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    used, found = 0, []
    for i, c in enumerate(a):
        lo = max(0, i - reach)
        free = places.get(c, 0) & ~used & (((1 << i + reach + 1) - 1) >> lo << lo)
        if free:
            used |= free & -free
            found.append(c)
    if not found:
        return 0.0
    other = [b[j] for j in range(len(b)) if used >> j & 1]
    m, swaps = len(found), sum(x != y for x, y in zip(found, other, strict=True)) // 2
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return float(_winkler((m / len(a) + m / len(b) + (m - swaps) / m) / 3, prefix))


def _jaro_words(a: list[str], b: list[str]) -> np.ndarray:
    p = _Pairs(b, a)  # the places of the second strings
    x, y = p.codes(p.y), p.codes(p.x)
    places = p.places(y)
    n, m = (np.array([len(s) for s in c], np.int64) for c in (a, b))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    used, hit = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    for i in range(x.shape[1]):
        window = _full(np.minimum(i + reach + 1, WORD)) & ~_full(np.minimum(np.maximum(i - reach, 0), WORD))
        free = places[p.rows, x[:, i]] & ~used & window
        low = free & (~free + np.uint64(1))
        used |= low
        hit |= np.where(low > 0, np.uint64(1 << i), np.uint64(0))
    found, swaps, left = np.bitwise_count(hit).astype(np.int64), np.zeros(len(a), np.int64), used.copy()
    for i in range(x.shape[1]):
        on = (hit >> np.uint64(i) & np.uint64(1)) > 0
        low = left & (~left + np.uint64(1))
        at = np.bitwise_count(np.where(on, low, np.uint64(1)) - np.uint64(1)).astype(np.int64)
        swaps += on & (p.x[p.rows, np.minimum(at, p.x.shape[1] - 1)] != p.y[:, i])
        left = np.where(on, left ^ low, left)
    prefix, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for i in range(min(4, p.x.shape[1], p.y.shape[1])):
        same &= (p.x[:, i] == p.y[:, i]) & (p.x[:, i] != 0)
        prefix += same
    f = np.maximum(found, 1)
    jaro = np.where(found > 0, (found / np.maximum(n, 1) + found / np.maximum(m, 1) + (found - swaps // 2) / f) / 3, 0.0)
    return _winkler(jaro, prefix)


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    fits = np.array([0 < len(x) <= WORD and 0 < len(y) <= WORD for x, y in zip(a, b, strict=True)], bool)
    return _apart(a, b, _jaro_words, jaro_winkler, fits)


BATCH = {
    "jaro_winkler": jaro_winklers, "ratio": ratios, "partial_ratio": partial_ratios,
    "token_sort_ratio": token_sort_ratios, "token_set_ratio": token_set_ratios, "weighted_ratio": weighted_ratios,
}


def all_of(names: tuple[str, ...], a: list[str], b: list[str]) -> dict[str, np.ndarray]:
    """Similarities in 0 to 1 of pairs of strings; each distinct pair is compared once."""
    distinct: dict[tuple[str, str], int] = {}
    back = np.array([distinct.setdefault(p, len(distinct)) for p in zip(a, b, strict=True)], np.int64)
    keep = list(distinct)
    x, y = [p[0] for p in keep], [p[1] for p in keep]
    none = np.array([not p or not q for p, q in keep], bool)
    out = {}
    for name in names:
        value = BATCH[name](x, y) / (1.0 if name == "jaro_winkler" else 100.0) if keep else np.zeros(0)
        out[name] = np.where(none, 0.0, value)[back] if keep else np.zeros(0)
    return out


def similarities(*names: str):
    """A function of two string columns to a struct of the named similarities, in one pass over a batch."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(all_of(names, a.fillna("").tolist(), b.fillna("").tolist()))

    return run
