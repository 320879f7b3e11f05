"""Packing token ids into fixed-length sequences: first-fit decreasing in random groups.

Documents are encoded, an end id is appended, and ids beyond the sequence length are cut
into full pieces and a rest. Pieces are dealt by a hash into groups of about
``GROUP_BYTES`` of text; in each group the rests, longest first, go to the first open
sequence with room, found in a tournament tree whose nodes hold the largest room below
them. Groups are independent, so one lost task repacks only its own. Their number
follows from the bytes of the texts alone, and so does the padding.

The hash takes the id, the piece, its content and its rank among the equal pieces of a
task, so a hot source or a group of copies spreads over all groups, and a task that
runs again deals alike in whatever order its rows come.

A null text counts as empty (the end id alone); null ids, repeated rows and ties are
kept as rows of their own (pieces of equal length stand in the order of id, start and
content); an empty table packs to nothing; a very long text is cut into pieces that
leave the task in small batches; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, tidy, utf8_size
from .encoders import encoder

GROUP_BYTES = 6 << 20
BATCH_IDS = 500_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, deal long"
PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


class Rooms:
    """A tournament tree: leaves are sequences, each node holds the largest room below it."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (max(n, 1) - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def take(self, length: int) -> int:
        """The first sequence with that much room, which is then taken."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        leaf = node - self.leaves
        tree[node] -= length
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return leaf


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; pieces are at most ``room`` long."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    rooms = Rooms(len(lengths), room)
    used = [0] * len(lengths)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        b = rooms.take(n)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
    return bins, offsets


def _cutter(path: str, kind: str, end_id: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind)
        end = np.array([end_id], enc.dtype)
        # How often a piece has come before: counted by a hash of 64 bits, so that equal pieces differ.
        before: Counter[int] = Counter()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            doc, start, length, total, raw, deal = [], [], [], [], [], []
            size = 0
            for key, ids in zip(batch.column(0).to_pylist(), enc.texts(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                whole = ids.tobytes()
                mark = hash((key, crc32(whole), len(whole)))
                nth = before[mark]
                before[mark] += 1
                for a in range(0, len(ids), room):
                    piece = ids[a : a + room]
                    doc.append(key)
                    start.append(a)
                    length.append(len(piece))
                    total.append(len(ids))
                    raw.append(piece.tobytes())
                    deal.append(nth)
                    size += len(piece)
                    if size > BATCH_IDS:
                        yield _pieces(doc, start, length, total, raw, deal)
                        doc, start, length, total, raw, deal = [], [], [], [], [], []
                        size = 0
            yield _pieces(doc, start, length, total, raw, deal)
        enc.rest()

    return tidy(run)


def _pieces(doc, start, length, total, raw, deal) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(raw, pa.binary()), pa.array(deal, pa.int64())], names=["doc_id", "start", "length", "doc_tokens", "ids", "deal"])


def _packer(room: int, wide: bool):
    def run(table: pa.Table) -> pa.Table:
        # Whatever order the rows come in, equal lengths are placed alike.
        table = table.append_column("crc", pa.array([crc32(x.as_buffer()) for x in table["ids"].combine_chunks()], pa.int64()))
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("crc", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), room)
        group = table["grp"][0].as_py()
        ids = table["ids"].combine_chunks()
        if not wide:
            ids = pa.array((np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in ids), pa.binary())
        give_back()
        return pa.table([table["doc_id"], table["start"], table["length"], table["doc_tokens"], ids, pa.array((group << 32) + bins), pa.array(offsets)], names=["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, room: int = 2048) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, ids (uint32), sequence_id, offset."""
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_cutter(tokenizer, kind, end_id, room), PIECES)
    size = rows.agg(F.sum(utf8_size(F.col("text")) + 1).alias("b")).first()["b"] or 0
    groups = max(1, round(size / GROUP_BYTES))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "deal", F.crc32("ids")), F.lit(groups))).drop("deal")
    return dealt.groupBy("grp").applyInArrow(_packer(room, wide), PACKED)


def pack_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    packed = pack(docs, tokenizer)
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
