"""From documents to packed sequences: rules, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelath.llm import mixing, near_dedup, packing, quality_rules, secrets
from wavelath.llm.common import staged, table
from wavelath.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps."""
    rows = quality_rules.ledger(docs, prefix="__q_")
    return rows.where(quality_rules.judge(rows, quality_rules.STANDARD, "__q_failed")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them masked."""
    return secrets.redact(docs, secrets.update(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 2048."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secret scans", secret_scan), ("source mixing", mix_sources), ("packing", pack)]
#: SQL can't say consistent weighted sampling or subword merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
