"""A corpus pipeline over documents; each stage works on all that its predecessor kept.

In every stage null text counts as empty, repeated rows are documents each (near_duplicates keeps one of them),
an empty table gives an empty one, and columns beside doc_id, text, source and n_chars are passed on whatever
their names are; the last stage gives pieces instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import packing, quality, simhash, suffix, toxicity
from locusframe.llm.common import materialise, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines over the limit."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 200 bytes repeat."""
    return suffix.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they lie in sequences."""
    return packing.packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("quality_rules", good), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeats), ("best_fit_packing", packed)]

#: Learned weights, XXH64 and suffix comparison can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
