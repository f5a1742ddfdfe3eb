"""A corpus from raw documents to shards: each stage is one operator of ``bitloom.llm`` at its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import decontaminate, extendible_shards, quality_knn, simhash_dedup, source_mix
from bitloom.llm._scratch import Scratch, read, removed_after


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts. Null texts and texts without words score as the sample's wordless texts, else 0.5, and go."""
    return quality_knn.keep_accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of SimHash near-duplicates the row with the smallest doc_id, null last; null and empty texts are one class."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark; null texts have no words and stay."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, each row as often as it is taken, in its shard's order; null texts have no words and are not taken."""
    return source_mix.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of the mix with the byte-bounded shard that each belongs to; null texts have no bytes."""
    return extendible_shards.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The classifier, XXH64 and hypergeometric draws are not SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again by the next.

    An empty table passes through every stage as an empty one. What a stage
    leaves in the shared folder is removed once its result is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for no, (_, stage) in enumerate(STAGES):
        with removed_after():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{no}")
        scratch.drop_all_but(f"stage-{no}")
    return docs
