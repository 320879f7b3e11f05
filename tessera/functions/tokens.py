"""The tokens of the channels for whole Arrow batches, with the skeleton of each word made once a worker.

Equal to the native columns on normalised texts (a test holds them together), at a fraction of their time.
Those of all records of a batch are distinct words, and the record and word of each token.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .text import KINDS, LOOK_ALIKE, SOUNDS

_ALIKE = str.maketrans(*LOOK_ALIKE)
_ALPHA, _DIGITS, _RUN = re.compile("[a-z]+"), re.compile("[0-9]+"), re.compile(r"(.)\1+")


@lru_cache(1 << 16)
def skeleton(t: str) -> str:
    if _DIGITS.search(t) and not _DIGITS.fullmatch(t):
        t = t.translate(_ALIKE)
    for a, b in SOUNDS:
        t = t.replace(a, b)
    t = _RUN.sub(r"\1", t)
    t = re.sub("(?<=.)[aeiouyh]", "", re.sub("^[aeiou]", "a", t))
    return _RUN.sub(r"\1", t)


def _number(x: str) -> str:
    return x.lstrip("0") or "0"


def tok4_of(name: str | None, addr: str | None) -> list[str] | None:
    if name is None or addr is None:
        return None
    names = [skeleton(x) for x in name.split(" ") if len(x) > 1]
    parts = [x for x in addr.split(" ") if x]
    alpha, codes, units = [], [], []
    for x in parts:
        if _ALPHA.fullmatch(x):
            s = skeleton(x)
            units.append(s)
            if len(x) > 1:
                alpha.append(s)
        elif _DIGITS.fullmatch(x):
            units.append(_number(x))
        else:
            units.append(x)
            codes.append(x)
    order = sorted(set(names))
    lists = {
        "n": names, "a": alpha, "c": codes, "d": map(_number, _DIGITS.findall(addr)), "b": [f"{x}_{y}" for x, y in zip(units, units[1:], strict=False)],
        "p": [f"{x}_{y}" for i, x in enumerate(order) for y in order[i + 1 :]],
    }
    return list(dict.fromkeys(f"{k}:{x}" for k in KINDS for x in lists[k]))


def tok4(name: str, addr: str):
    """A column of tokens from two columns of normalised texts."""

    @F.pandas_udf("array<string>")
    def run(names: pd.Series, addrs: pd.Series) -> pd.Series:
        return pd.Series(list(map(tok4_of, names, addrs)), dtype=object)

    return run(name, addr)


#: Distinct words, and the record and the word of each token, in the order of the records.
Tokens = tuple[pa.Array, np.ndarray, np.ndarray]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pc.fill_null(column.combine_chunks(), "")


def _grams(column: pa.ChunkedArray, n: int = 5) -> Tokens:
    """``text.char_ngrams`` of texts of letters a-z, digits and spaces: as numbers of n bytes."""
    text = pc.replace_substring(_whole(column), " ", "")
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(text.to_pylist()).encode() + bytes(n), np.uint8)
    if len(data) != size.sum() + n:
        raise ValueError("texts are not normalised")
    count = np.where(size > 0, np.maximum(1, size - n + 1), 0)
    rec = np.repeat(np.arange(len(size)), count)
    start = np.cumsum(size) - size
    at = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count) + start[rec]
    left = (start + size)[rec] - at
    gram = np.zeros(len(rec), np.int64)
    for i in range(n):
        gram = gram << 8 | np.where(left > i, data[at + i], 0)
    words, code = np.unique(gram, return_inverse=True)
    # The bytes of the numbers without the zeros at the end.
    raw = words.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - n :].copy().view(f"S{n}").ravel()
    return (pa.array([x.decode() for x in raw.tolist()], pa.string()), *_distinct(rec, code, len(words)))


def _distinct(rec: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(rec * max(1, n) + code)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key // max(1, n), key % max(1, n)


def _split(column: pa.ChunkedArray) -> Tokens:
    """Words that spaces part; empty ones are among them."""
    lists = pc.split_pattern(_whole(column), " ")
    words = pc.list_flatten(lists).dictionary_encode()
    rec = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return words.dictionary, rec, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _renamed(parts: list[tuple[list[str | None], np.ndarray, np.ndarray]]) -> Tokens:
    """Tokens whose words are written anew; null ones go."""
    words = pa.array([x for names, _, _ in parts for x in names], pa.string()).dictionary_encode()
    new = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.cumsum([0, *[len(names) for names, _, _ in parts]])
    rec = np.concatenate([r for _, r, _ in parts])
    code = np.concatenate([new[b + c] if len(c) else c for b, (_, _, c) in zip(base, parts, strict=False)])
    return (words.dictionary, *_distinct(rec[code >= 0], code[code >= 0], len(words.dictionary)))


def name_grams(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    return _grams(name)


def address_grams(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    return _grams(addr)


def address_words(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    words, rec, code = _split(addr)
    return _renamed([([x or None for x in words.to_pylist()], rec, code)])


@lru_cache(1 << 16)
def joint_skeleton(t: str) -> str:
    return re.sub("(?<=.)[aeiouyhw]", "", _RUN.sub(r"\1", t))


def joint_words(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    """``text.joint_tokens``."""
    (n, nr, nc), (a, ar, ac) = _split(name), _split(addr)
    names = [f"n:{joint_skeleton(x)}" if len(x) > 1 else None for x in n.to_pylist()]
    return _renamed([(names, nr, nc), ([f"a:{x}" if x else None for x in a.to_pylist()], ar, ac)])


def phonetic_words(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    """``text.tok4``."""
    return _listed(list(map(tok4_of, _whole(name).to_pylist(), _whole(addr).to_pylist())))


def _listed(lists: list[list[str]]) -> Tokens:
    words = pa.array([x for tokens in lists for x in tokens], pa.string()).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return (words.dictionary, *_distinct(np.repeat(np.arange(len(lists)), list(map(len, lists))), code, len(words.dictionary)))


def name_words(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    return address_words(addr, name)


def name_skeletons(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    """``text.name_skeletons``, distinct."""
    words, rec, code = _split(name)
    return _renamed([([skeleton(x) if len(x) > 1 else None for x in words.to_pylist()], rec, code)])


def _numbers(addr: str) -> list[str]:
    return list(dict.fromkeys(map(_number, _DIGITS.findall(addr))))


def numbers(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    """``text.numbers``."""
    return _listed(list(map(_numbers, _whole(addr).to_pylist())))


def _name_key(name: str) -> str:
    return " ".join(sorted({skeleton(x) for x in name.split(" ") if len(x) > 1}))


def name_keys(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    """``text.name_key``: one a record."""
    return _listed([[_name_key(x)] for x in _whole(name).to_pylist()])


def twin_keys(name: pa.ChunkedArray, addr: pa.ChunkedArray) -> Tokens:
    """``text.twin_key``: one a record."""
    return _listed([[f"{_name_key(x)}#{' '.join(sorted(_numbers(y)))}"] for x, y in zip(_whole(name).to_pylist(), _whole(addr).to_pylist(), strict=True)])
