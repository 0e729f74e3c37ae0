"""From documents to packed sequences: quality rules, one of each group of near duplicates, no repeated strings, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapdelta.llm import minhash, packing, quality, suffix
from snapdelta.llm.common import table, written
from snapdelta.llm.queries import word_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.one_of_each(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur again are cut out of the texts."""
    return suffix.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, word_tokenizer(), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("best_fit_packing", packed),
]

#: Minhashes and greedy packing have no equivalent in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents; every stage is written, and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
