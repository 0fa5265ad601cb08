"""Queries that apply each corpus operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import decontam, minhash, nbsvm, packing, pii, replytrees, sharding, streamdedup, tokens, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "duplicate_of")


def op4_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "duplicate_of")


OP5_SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS duplicate_of FROM documents
) WHERE text IS NOT NULL AND doc_id <> duplicate_of
"""


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replytrees.conversations(_table(spark, sf_dir, "conversations"))


def op2_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenised(_table(spark, sf_dir, "documents"))


def op7_url_alias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urlfilter.POLICY), "rule string, action string")
    return urlfilter.decide(_table(spark, sf_dir, "pages"), rules)


def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_shards, op2_orc_token_ids, op3_nbsvm_quality, op4_lsa_decontamination, op5_streaming_exact_dedup, op6_minhash_near_dedup, op7_url_alias_filter, op8_skip_chain_pii, op9_best_fit_packing, op10_reply_trees)}


def oracle_sql() -> dict[str, str]:
    return {"op1_hilbert_shards": sharding.oracle(), "op5_streaming_exact_dedup": OP5_SQL, "op7_url_alias_filter": urlfilter.oracle(), "op10_reply_trees": replytrees.oracle()}
