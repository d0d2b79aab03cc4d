"""The training-corpus pipeline: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import minhash, mixing, packing, quality, suffix
from tideline.llm.common import documents, staged
from tideline.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and are no outliers of their language and source."""
    return quality.keep(docs)


def minmax_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of near-duplicates."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier; texts with nothing left go.

    A character that a cut leaves incomplete is dropped.
    """
    # the row travels as one column, so that no name in it can clash
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*rest).alias("row"))
    left = suffix.deduplicate(rows, carry=["row"]).withColumn("text", F.expr("try_validate_utf8(cast(kept as string))"))
    whole = F.coalesce("text", F.expr("replace(make_valid_utf8(cast(kept as string)), '\\ufffd', '')"))
    left = left.withColumn("text", whole).where(F.length("text") > 0)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, shard by shard and shuffled inside each."""
    return mixing.drawn(docs, ordered=True).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("min-max near-dedup", minmax_near_dedup),
    ("suffix dedup", suffix_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Packing by a tokenizer has no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
