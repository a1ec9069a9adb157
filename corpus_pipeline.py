"""From raw documents to mixed and sharded training documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each result as
Parquet in the shared folder and reads it back as the next stage's input, then deletes what the stage and its
predecessor left there.

Defined results: rows with a null text fail the quality rules; rows with a null doc_id are judged by their text, are copies of nothing,
and stay; repeated rows are one document to near-dedup and are kept or dropped together; further columns pass through all stages as they are, but
for shard and slot, which the last stage sets; an empty table gives an empty result with these columns. Texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import common, decontamination, mixing, near_dedup, quality_rules, sharding


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of policy v1."""
    return quality_rules.passing_documents(docs, "v1")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.shard_rows(docs, 8)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: No SQL: components of near copies and hash-based sampling can't be expressed; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _name, stage in STAGES:
        with common.scratch() as keep:
            docs = common.stored(stage(spark, docs, sf_dir), "stage")
            keep.append(docs)
        if before is not None:
            common.release(before)
        before = docs
    return docs
