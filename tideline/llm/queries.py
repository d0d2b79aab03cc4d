"""Registered queries of the training-data operators: thin functions of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cotraining, covertree, divergence, gnat, minhash, mixing, packing, quality, sharding, substring, suffix
from .common import documents
from .oracles import ORACLES  # noqa: F401  (read by the registry)

SHARDS = 24


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    span = lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))
    return chat.rotate_perspectives(turns).withColumn("mask", F.array_join(F.transform("mask", span), ","))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(documents(spark, sf_dir)).drop("spans", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(documents(spark, sf_dir), weights=(1.0,) * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(documents(spark, sf_dir)).drop("factors", "kept")


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "pages"))
    return cotraining.classify(documents(spark, sf_dir), labels, pages)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select(
        "doc_id", "size", "source_size", "target", "taken", "copies", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("d2")


def op10_covertree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_gnat_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = gnat.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = codebooks.digest() if codebooks else gnat.EMPTY_DIGEST
    return codes.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(documents(spark, sf_dir), file, pattern), file, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minmax_near_dedup": op4_minmax_near_dedup,
    "op5_rendezvous_shards": op5_rendezvous_shards,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_cotrained_quality": op7_cotrained_quality,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_rules": op9_quality_rules,
    "op10_covertree_near_dedup": op10_covertree_near_dedup,
    "op11_gnat_vector_codes": op11_gnat_vector_codes,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_source_divergence": op13_source_divergence,
}
