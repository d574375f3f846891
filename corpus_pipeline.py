"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.common import materialise, prepare
from docweave.llm.exact_dedup import drop_duplicates
from docweave.llm.language_id import drop_unidentified
from docweave.llm.mixing import TARGETS, labelled_domains, mixed_corpus
from docweave.llm.packing import pack_documents
from docweave.llm.simhash_dedup import drop_near_duplicates

#: Learned models, fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds the brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or without letters) go."""
    prepare(spark)
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepare(spark)
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (shingles of 3 words, 2 bits)."""
    prepare(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate for the target weights says."""
    prepare(spark)
    labels = labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed_corpus(docs, labels, TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
