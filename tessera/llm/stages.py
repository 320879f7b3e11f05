"""The stages of the corpus pipeline; each calls one operator and applies its decisions.

Every function takes (spark, docs, sf_dir) and returns the columns of ``docs`` (the last
one returns packed pieces).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, mixing, packing, suffix_dedup
from . import toxicity as tox
from .common import table
from .encoders import public_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_USED = ("doc_id", "text", "lang", "source", "n_chars")


def _keeping_columns(stage: Stage) -> Stage:
    """Carry other columns through under names that no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        safe = [c if c in _USED else f"_carried_{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*safe), sf_dir).toDF(*names)

    return run


@_keeping_columns
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.5 or more."""
    machine = tox.train(docs, table(spark, sf_dir, "labels"))
    text = F.col("text").cast("string")
    named = docs.withColumn("text", text)
    return tox.score(named, machine).where("score < 0.5").select(*named.columns)


@_keeping_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group (five words a shingle, similarity 0.8)."""
    found = minhash.near_duplicates(docs, width=5, num=8, den=10)
    drop = found.where("not kept").select("doc_id").distinct()
    rest = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    # Rows that repeat with id and text have equal sets and share the kept id; one stays.
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = rest.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(twice)


@_keeping_columns
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes and more that occur twice, in whole characters."""
    return suffix_dedup.cut_repeats(docs, characters=True).select(*docs.columns)


@_keeping_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target shares."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    return packing.pack(docs, public_path("word_bpe_49k.json"))
