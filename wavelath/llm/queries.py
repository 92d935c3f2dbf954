"""The training-data operators as queries over whole tables, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, lang_id, mixing, near_dedup, packing, quality_model, quality_rules, repair, secrets, token_counts
from .common import staged, table
from .tokens import vocabulary


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair.encode_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return repair.documents(staged(shards, "shards"))


def secret_ledger_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 in two runs: a stored ledger of half the documents, then all of them, of which only unseen blobs are scanned."""
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.update(docs.where("doc_id % 2 = 0")))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What versioned policies keep, with and without each of their rules, from the stored ledger of all documents."""
    return quality_rules.ablations(quality_rules.stored(table(spark, sf_dir, "documents")), list(quality_rules.POLICIES))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_minhash_near_dedup, op3_secret_scans, op4_token_files, op5_language_id, op6_embedding_near_dedup, op7_quality_classifier, op8_token_counts, op9_packing, op10_source_mixing, secret_ledger_increment, quality_ablations)}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "op3_secret_scans": secrets.ORACLE, "op6_embedding_near_dedup": embedding_dedup.ORACLE, "secret_ledger_increment": secrets.ORACLE, "quality_ablations": quality_rules.ABLATIONS_ORACLE}
