"""Stage tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
#: While a stage table is written: shuffle files go with their query, and Arrow batches stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a session on one machine (a local master, as in tests) may leave it unset and gets
    a temporary folder; on a cluster the executors would not see one another's files, so
    that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tessera-')}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stage table through the file system that Spark uses for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all stage tables of this session; results that read them must be written before."""
    for path in list(_WRITTEN.get(spark.sparkContext.applicationId, [])):
        remove(spark, path)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a stage table; what is still there when the interpreter ends is deleted."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        atexit.register(_at_exit, spark, os.getpid())
    _WRITTEN[app].append(path)
    return path


def _at_exit(spark: SparkSession, pid: int) -> None:
    if os.getpid() != pid:
        return
    try:
        clear(spark)
    except Exception:  # the session may be gone when the interpreter ends
        pass


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    This cuts the lineage: a lost executor re-reads files that all machines share.
    """
    spark = df.sparkSession
    path = path or table_path(spark, name)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    with _writing(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
