"""Exact, memoised use of public tokenizers on many texts at once.

Texts are cut into units at places where the tokenizer's own pre-tokenizer must cut:
before white space, after white space other than a plain space, and between a letter
and one closing sign that is followed by white space or the end. Each distinct unit is
encoded by the tokenizers library once while the bounded memo holds it; ids of whole
texts are gathered with numpy. A text outside the proven cases (runs of white space and
white space beyond ASCII, where a byte-level pre-tokenizer looks ahead) goes to the
library as it is, so that the ids always equal those of a direct call; so does a text
that holds the string of an added token, which the library cuts out first.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .textvec import LOWER, WHITE, chunks, span_hashes

MEMO_UNITS = 2_500_000
KEPT_UNITS = 2_400_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ".,;:!?"]] = True
_MARK = "␞"


class _Memo:
    """Ids by the hash of their unit: open addressing in flat arrays that only double.

    When it is full, units that came in one chunk only are forgotten.
    """

    def __init__(self, dtype: np.dtype):
        self.n = self.used = 0
        self.flat = np.empty(1 << 18, dtype)
        self._room(16)

    def _room(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.key = np.zeros(1 << bits, np.uint64)  # 0 is empty
        self.at = np.zeros(1 << bits, np.int32)
        self.length = np.zeros(1 << bits, np.int32)
        self.chunks = np.zeros(1 << bits, np.uint8)

    def forget(self, limit: int) -> None:
        """Keep at most ``limit`` units, those that came most often."""
        often = 2
        while (keep := self.chunks >= often).sum() > limit and often < 255:
            often += 1
        if often == 255:
            keep[:] = False
        hashes, at, length, chunks = self.key[keep], self.at[keep].astype(np.int64), self.length[keep], self.chunks[keep]
        stop = np.cumsum(length, dtype=np.int64)
        flat = self.flat[np.repeat(at - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        self.n, self.used = len(hashes), len(flat)
        self.flat = np.append(flat, np.empty(1 << 18, flat.dtype))
        self._room(max(16, (2 * self.n).bit_length()))
        self._put(hashes, (stop - length).astype(np.int32), length)
        self.chunks[self.find(hashes)] = chunks // 2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for new ones."""
        out = np.full(len(hashes), -1, np.int64)
        todo, place = np.arange(len(hashes)), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            key = self.key[place]
            hit = key == hashes[todo]
            out[todo[hit]] = place[hit]
            on = ~hit & (key != 0)
            todo, place = todo[on], (place[on] + 1) & self.mask
        return out

    def _put(self, hashes: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        place = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(hashes):
            free = self.key[place] == 0
            self.key[place[free]] = hashes[free]  # of several that meet in a slot the last one stays
            done = self.key[place] == hashes
            self.at[place[done]], self.length[place[done]] = at[done], length[done]
            hashes, at, length, place = hashes[~done], at[~done], length[~done], (place[~done] + 1) & self.mask

    def add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """New hashes, each once, with their ids."""
        self.n += len(hashes)
        if self.n > 0.6 * self.mask:
            full = self.key != 0
            old, chunks = (self.key[full], self.at[full], self.length[full]), self.chunks[full]
            self._room(max(self.mask.bit_length() + 1, (2 * self.n).bit_length()))
            self._put(*old)
            self.chunks[self.find(old[0])] = chunks
        length = np.array([len(x) for x in ids], np.int32)
        end = self.used + int(length.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * end - self.used, self.flat.dtype)])
        self.flat[self.used : end] = np.concatenate(ids)
        self._put(hashes, (self.used + np.cumsum(length) - length).astype(np.int32), length)
        self.used = end


class Encoder:
    """``kind``: ``byte`` for byte-level BPE whose words carry their leading space,
    ``word`` for lower-casing BPE with word ends that drops white space."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = kind
        self.joint = "\n" if kind == "byte" else f"\n{_MARK}\n"
        self.mark = self.direct(self.joint)
        self.memo = _Memo(self.dtype)

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Units in one call, joined by a mark whose ids no unit can hold."""
        odd = (lambda u: u.strip(" ") == "" or any(c in u for c in "\n\t\r\x0b\x0c")) if self.kind == "byte" else (lambda u: _MARK in u or not u.strip())
        out: list[np.ndarray | None] = [self.direct(u) if odd(u) else None for u in units]
        plain = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(plain), 4000):
            part = plain[lo : lo + 4000]
            ids = self.direct(self.joint.join([units[i] for i in part]))
            m = self.mark
            hit = ids == m[0]
            for k in range(1, len(m)):
                hit[:-k] &= ids[k:] == m[k]
                hit[-k:] = False
            ends = np.flatnonzero(hit)
            pieces = [ids[a:b] for a, b in zip([0, *(ends + len(m))], [*ends, len(ids)], strict=True)]
            if len(pieces) != len(part):  # a unit with the mark's ids: never seen, still exact
                pieces = [self.direct(units[i]) for i in part]
            for i, x in zip(part, pieces, strict=True):
                out[i] = x
        return out

    def _cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        white = WHITE[buf]
        sign = np.flatnonzero(_SIGN[buf])
        sign = sign[(sign > 0) & ~cut[sign]]
        before = buf[sign - 1]
        letter = _LETTER[before] | ((before >= 0x80) & (before != 0x97) & (before != 0xB7) & (buf[sign - 2] == 0xC3))
        closed = cut[sign + 1] | np.append(white, True)[sign + 1]
        cut[:-1] |= white
        cut[np.flatnonzero(white & (buf != 32)) + 1] = True
        cut[sign[letter & closed]] = True
        return np.flatnonzero(cut[:-1])

    def _odd_texts(self, buf: np.ndarray, low: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows with an added token, runs of white space or white space beyond ASCII."""
        places = [np.array(self._finds(low.tobytes(), t), np.int64) for t in self.added]
        if self.kind == "byte" and len(buf) > 1:
            a, b = buf[:-1], buf[1:]
            c = np.append(buf[2:], 0)
            bad = WHITE[a] & WHITE[b]
            bad |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            bad |= ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
            bad |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            places.append(np.flatnonzero(bad))
        return np.unique(np.searchsorted(off, np.concatenate(places), "right") - 1) if places else np.empty(0, np.int64)

    @staticmethod
    def _finds(raw: bytes, token: bytes) -> list[int]:
        out, at = [], raw.find(token)
        while at >= 0:
            out.append(at)
            at = raw.find(token, at + 1)
        return out

    def encode_chunk(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        n = len(off) - 1
        if not len(buf):
            return [np.empty(0, self.dtype)] * n
        odd = self._odd_texts(buf, LOWER[buf], off)
        low = LOWER[buf] if self.kind == "word" else buf
        starts = self._cuts(low, off)
        ends = np.append(starts[1:], len(low))
        hashes, first, inverse = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        hashes[hashes == 0] = 1
        place = self.memo.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.memo.n + len(new) > MEMO_UNITS:
                self.memo.forget(MEMO_UNITS // 2)
                new = np.flatnonzero(self.memo.find(hashes) < 0)
            raw = low.tobytes()
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self.memo.add(hashes[new], self._encode_units([raw[x:y].decode("utf-8", "replace") for x, y in zip(s, e, strict=True)]))
            place = self.memo.find(hashes)
        self.memo.chunks[place] += self.memo.chunks[place] < 255
        at, length = self.memo.at[place][inverse].astype(np.int64), self.memo.length[place][inverse].astype(np.int64)
        stop = np.cumsum(length)
        flat = self.memo.flat[np.repeat(at - (stop - length), length) + np.arange(stop[-1])]
        bounds = np.append(0, stop)[np.searchsorted(starts, off)]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in odd.tolist():
            out[i] = self.direct(buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
        return out

    def rest(self) -> None:
        """Between tasks a worker keeps the common units only."""
        if self.memo.n > KEPT_UNITS:
            self.memo.forget(KEPT_UNITS)

    def texts(self, column: pa.Array):
        """The ids of each text of an Arrow column, in order; null counts as empty."""
        for _, buf, off in chunks(column):
            yield from self.encode_chunk(buf, off)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    key = (path, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, kind)
    return _ENCODERS[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
