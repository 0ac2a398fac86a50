"""The queries of the training-data operators with their production parameters, and the pipeline over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, near_dedup, quality, scoring, sharding, substring_dedup, suffix_dedup, token_counts, wrappers
from .common import table


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.flag_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_id", F.coalesce("item_id", F.lit(-1)))


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op3_spaced_seed_decontamination, op4_hash_tree_sharding, op9_raked_mixing)}
ORACLES: dict[str, str] = {"op9_raked_mixing": mixing.mix_sql(0.7, 0.8, 12), "op4_hash_tree_sharding": sharding.shard_sql(), "op3_spaced_seed_decontamination": decontaminate.leaks_sql()}


def op2_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents"))


QUERIES[op2_context_tree_scoring.__name__] = op2_context_tree_scoring


def op5_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op5_boosted_quality_rules, op10_offset_token_counts)}


def op6_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


QUERIES |= {f.__name__: f for f in (op6_doubling_substring_dedup, op8_suffix_array_dedup)}


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("__doc", "__component")


QUERIES[op1_minhash_near_dedup.__name__] = op1_minhash_near_dedup


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(table(spark, sf_dir, "pages"))


QUERIES[op7_wrapper_induction.__name__] = op7_wrapper_induction

ORACLES |= {"op1_minhash_near_dedup": near_dedup.components_sql(), "op6_doubling_substring_dedup": substring_dedup.removed_sql(), "op8_suffix_array_dedup": suffix_dedup.removed_sql()}
