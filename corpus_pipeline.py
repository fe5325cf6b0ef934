"""Corpus preparation: drop poor and toxic documents, keep one of each near-duplicate group, cut repeated passages, pack.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``. The classifiers are
fitted on the rows that reach their stage and on the labels of ``sf_dir``, the near-duplicate stage works on shingles of five
words. Nulls, empty and repeated rows are treated as the operators say; an empty table stays empty through all stages. Every stage
reads texts whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import near_dedup, packing, quality_trees, suffix_dedup, toxicity
from holdfast.llm.common import stored, table
from holdfast.llm.queries import END_OF_TEXT

#: SQL cannot express the fitted classifiers; tests compare ``run`` with a plain version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_trees.keep_good(docs, quality_trees.train(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_OF_TEXT, end=1)


STAGES = [
    ("quality_classifier", good_quality), ("toxicity", not_toxic), ("near_dedup", one_of_near_duplicates),
    ("suffix_dedup", without_repeated_passages), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again, the last one is returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
