"""A pipeline over ``documents``: five stages of the text operators, each stored before the next one reads it.

Defined cases: a null, empty or wordless text is rejected by the first stage, unless there are no labels to learn from,
when only texts with a word stay; a null doc_id is no member of a group of near duplicates and stays; rows with the same
doc_id that the duplicates stage keeps stay once; empty tables give empty results; columns beyond those of documents
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import decontaminate, near_duplicates, packing, quality, secrets
from stratum.llm.common import shared_folder, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: the passage goes, or the document if most of it is one."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced by a mark."""
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, MinHash candidates or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            folder = shared_folder(spark)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
