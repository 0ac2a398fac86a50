"""Training-corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept and returns a DataFrame; all
but the last return the columns of documents. ORACLE_SQL is None: the first two stages (boosted trees, MinHash) cannot be
said in SQL; the tests hold every stage against a plain version.

Nulls in any column, repeated rows, empty and very long texts, columns named like the operators' own and tables without
rows pass through every stage; what each makes of them stands in its docstring. A doc_id is a whole number or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import decontaminate, mixing, near_dedup, quality, sharding
from grainmill.llm.common import materialize, table

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the boosted trees reject go. A null or blank text has under 20 words and goes;
    equal rows get the same verdict; without labels of both classes the base rules decide alone."""
    return quality.judge_documents(docs, table(spark, sf_dir, "labels"), only_kept=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity 0.8): the one of the least doc_id, a
    null one first; of rows equal in id and text one. Documents without words are in no group and stay."""
    return near_dedup.keep_first(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go; a null or empty text holds none, and without benchmark items all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their calibrated probabilities. Nulls in source or lang are categories of their own, a null text
    counts as one token; equal rows share their fate."""
    return mixing.mix_documents(docs, digest=False).where("kept").select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard and slot; all columns stay. A null doc_id is the key 'null'; equal rows share a shard, not a slot."""
    return sharding.shard_documents(docs, digest=False)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i + 1}")
    return docs
