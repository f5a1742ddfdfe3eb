"""The subpackage's registered queries, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import chat_format, decontaminate, extendible_shards, hamming_topk, hard_negatives, language_id, pii, quality_knn, sequence_packing, simhash_dedup, source_mix, token_counts, vector_codes
from bitloom.llm._scratch import read

#: Every row whose id is divisible by this is a query of the top-k search.
QUERY_EVERY = 50
#: Rows of the hard-negative query whose id is divisible by this get the next label of ten.
RELABEL_EVERY = 7


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(token_counts.count_tokens(read(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(read(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards.shard(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard_id", "shard_bytes", "oversize")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find_windows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat_format.END}{chat_format.START}assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat_format.digests(chat_format.format_chats(rows.unionByName(planted)))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.mix(read(spark, sf_dir, "documents"))
    taken = F.col("mix_size") * F.size("mix_copies")
    copies = F.array_join(F.transform("mix_copies", lambda c: F.concat_ws(":", c["epoch"], c["shard"], c["place"])), ",")
    return mix.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"), copies.alias("copies"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_topk.sign_code(F.col("embedding")).alias("code"))
    found = hamming_topk.top_k(codes, codes.where(F.col("id") % QUERY_EVERY == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_classes(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(*vector_codes.compress(read(spark, sf_dir, "embeddings")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % QUERY_EVERY == 0)


def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_packing.digests(sequence_packing.pack(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_token_counts, op3_pii, op4_sharding, op5_decontamination, op6_chat_format, op7_source_mix, op8_language_id, op9_hamming_topk, op10_simhash_dedup, op11_vector_codes, op12_hard_negatives, op13_sequence_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_pii": pii.oracle_sql(),
        "op4_sharding": extendible_shards.oracle_sql(),
        "op5_decontamination": decontaminate.oracle_sql(),
        "op6_chat_format": chat_format.oracle_sql(),
        "op9_hamming_topk": hamming_topk.oracle_sql(QUERY_EVERY),
        "op11_vector_codes": vector_codes.oracle_sql(),
        "op12_hard_negatives": hard_negatives.oracle_sql(QUERY_EVERY, RELABEL_EVERY),
    }
