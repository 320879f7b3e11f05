"""Greedy longest-match word-piece counts by a linear automaton.

The vocabulary is a trie. Each node has a failure link and the number of pieces that
are popped when it is followed, both computed once, so that a word is read once, with
no backtracking and without building its pieces (the public LinMaxMatch scheme). Words
are the runs between white space; each is matched with a word mark in front; a word
that greedy matching cannot cover counts as one unknown token.

A null or empty text has no words and no tokens; null ids and repeated rows are kept as
they are; an empty table gives an empty one; other columns are ignored. Very long words
take linear time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

MARK = "▁"
MEMO_WORDS = 400_000


class LongestMatch:
    def __init__(self, vocabulary: Iterable[str]):
        step: list[dict[str, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                if c not in step[node]:
                    step[node][c] = len(step)
                    step.append({})
                    final.append(False)
                node = step[node][c]
            final[node] = node != 0
        fail = [-1] * len(step)
        pops = [0] * len(step)
        queue = [0]
        for u in queue:
            for c, v in step[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and c not in step[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = step[z][c], n
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: str) -> int:
        """Pieces of the word; 1 if it has none that cover it; 0 for the empty word."""
        step, fail, pops = self.step, self.fail, self.pops
        u = n = 0
        for c in word:
            while c not in step[u]:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = step[u][c]
        while u:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


_CACHE: dict[str, _Counts] = {}


def piece_vocabulary(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CACHE:
            _CACHE[path] = _Counts(LongestMatch(piece_vocabulary(path)))
        of = _CACHE[path].__getitem__
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(of, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return tidy(run)


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counter(vocabulary), "doc_id long, n_words long, n_tokens long")
