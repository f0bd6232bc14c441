"""The corpus pipeline: documents are filtered, deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept,
and returns a DataFrame. All stages but the last return the columns of
documents. run() writes each stage's rows as Parquet in the shared folder and
reads them again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recoflux.llm import decontamination, jaccard, packing, phrases, quality
from recoflux.llm.common import cut, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5) go.

    The classifier learns from labelled documents that aren't held out; a text that is null or empty gets the prior.
    """
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.8 or more, the least doc_id stays."""
    return jaccard.keep_one_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """50-word passages of documents with smaller ids are taken out; documents with nothing left go."""
    return phrases.remove_passages(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others, the words inside benchmark windows are taken out."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 2048 tokens."""
    return packing.op4_packing(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_passages),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: No SQL expresses the classifier or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
