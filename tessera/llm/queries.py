"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, minhash, mixing, packing, sharding, suffix_dedup, token_counts, token_files, topk_search, toxicity
from .common import table
from .encoders import public_path


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digest(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op7_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16, keep=["doc_id"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_token_counts, op3_suffix_dedup, op4_mix_sources, op5_pack, op6_minhash, op7_embed_dedup, op8_shard, op9_toxicity, op10_token_files)}
ORACLE_SQL = {
    "op1_topk_search": topk_search.top_k_sql(),
    "op3_suffix_dedup": suffix_dedup.suffix_sql(),
    "op4_mix_sources": mixing.mixing_sql(),
    "op6_minhash": minhash.near_duplicates_sql(),
    "op7_embed_dedup": embed_dedup.near_vectors_sql(),
    "op8_shard": sharding.sharding_sql(),
}
