"""The corpus pipeline: each stage reads its predecessor's documents and writes its own.

Quality rules drop rejected documents, SimHash near-dedup keeps one document of each group, benchmark
decontamination drops documents with benchmark passages, personal data gets surrogates, and the last stage
encodes the texts and decodes them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajspark.llm import bpe, decontaminate, pii_surrogates, quality_rules, simhash_dedup
from trajspark.llm.common import table, written
from trajspark.llm.queries import PII_KEY


#: Bytes of the Arrow batches between Spark and its Python workers, so that whole rows pass in little memory.
BATCH_BYTES = "8m"


def _settings(spark: SparkSession) -> None:
    """The pipeline is an application: it sets the session that its stages run in."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return simhash_dedup.simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return pii_surrogates.replace_pii(docs, PII_KEY)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _settings(spark)
    return bpe.encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", encoding),
]

#: The forest, the hashes and the encoding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
