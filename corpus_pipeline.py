"""Corpus pipeline: filter by quality and toxicity, keep one of each group of near copies, mix the sources,
and encode what is left.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns rows with the columns of
documents, but for the last, which returns each row's token count and digests. Labels are those of the
given tables; which rows teach the classifiers is decided among the stage's own input.

Defined cases are those of the operators: rows without text count as empty texts, repeated rows are rows
of their own until the near-copy stage keeps one of them, and an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import bpe_tree, jaccard_join, mixing, quality_cnn, toxicity_fst
from strandlake.llm.common import spill_table, table

#: Near copies: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_fst.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs, WORDS, PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(docs)


STAGES = [
    ("quality classifier", good),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: Learned classifiers and byte-pair merges are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill_table(docs, f"stage{k}")
    return docs
