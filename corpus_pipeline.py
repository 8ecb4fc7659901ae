"""A training corpus from raw documents: five stages, each one operator of layoutq.llm, each written and read again.

Quality rules drop documents; of each group of near-duplicates one stays; personal data are replaced by their kind; the mix takes
documents by source, some more than once; the last stage packs what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layoutq.llm.common import read, stored
from layoutq.llm.jaccard_join import one_of_each
from layoutq.llm.packing import packed
from layoutq.llm.private_data import redacted
from layoutq.llm.quality_rules import kept_documents
from layoutq.llm.source_mixing import mixed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("private_data", redaction), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: Tokens, MinHash and boosted trees have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
