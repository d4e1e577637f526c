"""From raw documents to packed sequences, in five stages.

Each stage works on all that its predecessor kept; its result is written as
Parquet in the shared folder and read again. Documents that the quality rules
reject go, one document of each near-duplicate group stays, documents that hold
a benchmark item go, secrets are replaced by a mark, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, near_copies, packing, quality_rules, secrets
from plumbline.llm.base import documents, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.secret_scan(docs, secrets.fresh_ledger(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secret_scan", hide_secrets),
    ("packing", pack),
]

#: Fingerprint components, redaction and packing have no SQL twin; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
