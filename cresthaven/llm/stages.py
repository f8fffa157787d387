"""The stages of the corpus pipeline: language ID, near-dedup, repeat removal, decontamination, BPE.

All hold this in common: only doc_id and text (and lang where it is learned from) are read, whatever other columns
there are and whatever these are called; all but the last return the documents' columns; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language_id, simhash_dedup, suffix_dedup
from .common import table, written

ORACLE_SQL = None  # no stage but op3's and op1's can be written in SQL; tests/llm compare each with a brute-force version


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: texts that are null, empty or have no letter, and those found with a probability under 0.4.

    Null ids stay; rows that repeat stay as often as they come.
    """
    return language_id.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of least doc_id (see ``simhash_dedup.drop_near_duplicates`` for ties and nulls)."""
    return simhash_dedup.drop_near_duplicates(docs, 4)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each 100-byte passage stays where it comes first; documents of which nothing is left go (see ``suffix_dedup.dedup_documents``)."""
    return suffix_dedup.dedup_documents(docs, 100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go; null and empty texts and items match nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but text, and n_tokens, ids (joined by one space) and the digests of ids and decoded text.

    Null and empty texts have no tokens and stay; a column of the documents that is called as one of these is replaced.
    """
    import public_tokenizers

    return bpe.tokenised(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
