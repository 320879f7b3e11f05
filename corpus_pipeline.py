"""A training-corpus pipeline over ``documents``: filter, de-duplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import materialize, table

STAGES = [
    ("toxicity", stages.toxicity),
    ("near_dedup", stages.near_dedup),
    ("passage_dedup", stages.passage_dedup),
    ("mix_sources", stages.mix_sources),
    ("pack", stages.pack),
]
#: Hashing, learning and suffix sorting have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
