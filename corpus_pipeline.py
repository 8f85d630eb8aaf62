"""The corpus pipeline: quality rules, language ID, near-dedup, mixing, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, langid, mixing, near_dedup, quality
from lodestack.llm.common import held_out, shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_passing(docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    return langid.reject_unreadable(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("language_id", keep_language),
    ("near_dedup", keep_distinct),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Tokenisers and trained classifiers have no SQL. tests/llm compares every stage with a version in plain Python, on what
#: the stage before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    shared = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared}/pipeline-{spark.sparkContext.applicationId}-{id(docs)}-{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
