"""Partition counts and small column helpers shared by the operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize, remove, scratch_root, table, table_path

__all__ = ["give_back", "materialize", "partitions_for", "remove", "scratch_root", "semi_by_id", "slices", "table", "table_path", "tidy", "utf8_size"]

#: Ids of at most so many rows may be broadcast (8 bytes each); beyond it tables are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SLICE_BYTES = 2 << 20


def partitions_for(df: DataFrame, target_bytes: int, at_least: int | None = None) -> int:
    """A partition count from the plan's size estimate; it grows with the input."""
    spark = df.sparkSession
    least = at_least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, math.ceil(size / target_bytes)) if size < 1 << 56 else least


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is in the stage table ``ids``.

    Ids of a checked number are broadcast, so the rows left out never move; more ids are
    joined by a shuffle, with the same result.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about ``limit`` bytes of text each, one row at least."""
    text = batch.column(column)
    n, lo, held = batch.num_rows, 0, 0
    for i, size in enumerate(pc.binary_length(text).to_pylist()):
        held += size or 0
        if held >= limit:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0
    if lo < n:
        yield batch.slice(lo)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker's function that gives memory back at the end of its task: workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _fixed_threshold()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def _fixed_threshold() -> None:
    """Arrays of a MB and more go back to the system when they are dropped (glibc's M_MMAP_THRESHOLD)."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
