"""The corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents. run()
writes each stage's result as Parquet in the shared folder and reads it again as the next stage's input; what a stage needed on
the way is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, packing, quality, secret_scan, simhash
from tessera.llm.common import table
from tessera.llm.queries import tokenizer_file
from tessera.storage import Workspace, cleared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars brought up to date."""
    return secret_scan.redacted(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", sequence_packing),
]
#: SimHash, alignment and tokens can't be put in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with cleared():
            docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
