"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

A file table holds segments of whole documents in ascending ``doc_id`` order. In a
segment the ids are replaced by their frequency rank, so that common ids take one byte;
the lengths (1 to 4 bytes, two bits each, four to a control byte) are kept apart from
the data bytes, and numpy decodes both by table lookup. Segments carry their own rank
table and can be decoded alone; a lost task is simply written again.

Columns: version, shard, segment, n_docs, n_ids, doc_ids, doc_nulls, lengths, ranked,
control, data (little-endian arrays in binary columns).

Rows with a null ``doc_id`` come first and keep it; a null or empty text gives the end
id alone; repeated rows are all kept; an empty table gives an empty file; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, slices, table_path, tidy
from .encoders import encoder

VERSION = 1
SEGMENT_IDS = 1_000_000
FILE_SCHEMA = "version int, shard int, segment int, n_docs int, n_ids long, doc_ids binary, doc_nulls binary, lengths binary, ranked binary, control binary, data binary"
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_segment(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked ids, control, data): rank 0 is the most frequent id, ties to the smaller id."""
    count = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(count)
    ranked = used[np.argsort(-count[used], kind="stable")]
    rank = np.zeros(len(count), np.uint32)
    rank[ranked] = np.arange(len(ranked))
    return (ranked.astype("<u4").tobytes(), *pack_values(rank[ids]))


def unpack_segment(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranked, "<u4")[unpack_values(control, data, n)] if n else np.empty(0, np.uint32)


def _writer(path: str, kind: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, names = encoder(path, kind), [f.split()[0] for f in FILE_SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64() if t == "long" else pa.int32()) for n, t in (f.split() for f in FILE_SCHEMA.split(", "))])
        doc_ids: list[int] = []
        nulls: list[bool] = []
        parts: list[np.ndarray] = []
        held = segment = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], "<u4")
            ids = np.concatenate(parts)
            row = [VERSION, shard, segment, len(parts), len(ids), np.array(doc_ids, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), lengths.tobytes(), *pack_segment(ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], names=names)

        end = np.array([end_id], np.uint32)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, enc.texts(batch.column(1)), strict=True):
                doc_ids.append(key or 0)
                nulls.append(key is None)
                parts.append(np.concatenate([ids, end]))
                held += len(ids) + 1
                if held >= SEGMENT_IDS:
                    yield flush()
                    doc_ids, nulls, parts, held, segment = [], [], [], 0, segment + 1
        if parts:
            yield flush()
        enc.rest()

    return tidy(run)


def write_token_files(docs: DataFrame, tokenizer: str, kind: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encode all texts and write the file table at ``path``; returns it read back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions_for(rows, 24 << 20)
    # The second key deals out repeated ids; texts of one id stay in a fixed order.
    tie = F.xxhash64("text")
    ordered = rows.withColumn("_tie", tie).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").drop("_tie")
    return materialize(ordered.mapInArrow(_writer(tokenizer, kind, end_id), FILE_SCHEMA), "token-files", path or table_path(docs.sparkSession, "token-files"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            if r["version"] != VERSION:
                raise ValueError(f"token file version {r['version']}")
            ids = unpack_segment(r["ranked"], r["control"], r["data"], r["n_ids"])
            lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
            stop = np.cumsum(lengths)
            keys = np.frombuffer(r["doc_ids"], "<i8")
            mask = np.frombuffer(r["doc_nulls"], np.uint8).astype(bool)
            n = len(lengths)
            for lo in range(0, n, 2000):
                hi = min(n, lo + 2000)
                raw = [ids[a:b].tobytes() for a, b in zip((stop - lengths)[lo:hi].tolist(), stop[lo:hi].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo:hi], pa.int64(), mask=mask[lo:hi]), pa.array(np.full(hi - lo, r["shard"], np.int32)), pa.array(np.full(hi - lo, r["segment"], np.int32)), pa.array((stop - lengths)[lo:hi]), pa.array(lengths[lo:hi]), pa.array(raw, pa.binary())],
                    names=["doc_id", "shard", "segment", "local", "n_tokens", "ids"],
                )


def read_token_files(files: DataFrame, content: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32).

    ``content`` is what to keep in place of the ids; it is made before rows are moved.
    """
    content = F.col("ids") if content is None else content
    wanted = files.select("version", "shard", "segment", "n_ids", "doc_ids", "doc_nulls", "lengths", "ranked", "control", "data")
    docs = wanted.mapInArrow(tidy(_reader), "doc_id long, shard int, segment int, local long, n_tokens long, ids binary")
    docs = docs.select("doc_id", "shard", "segment", "local", "n_tokens", content)
    kept = docs.columns[-1]
    sizes = files.select("shard", "segment", "n_ids")
    before = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = sizes.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # One row a shard: the only step over all shards in one task.
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shards_before", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    offsets = in_shard.join(shards, "shard").select("shard", "segment", (F.col("in_shard") + F.col("shards_before")).alias("base"))
    return docs.join(offsets, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", kept)


def token_digest(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2) -> DataFrame:
    files = write_token_files(docs, tokenizer, kind, end_id)
    return read_token_files(files, F.crc32("ids").cast("long").alias("ids_crc32"))

