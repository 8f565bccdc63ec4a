"""Corpus pipeline: documents to packed training sequences, one stage after the other.

Each stage works on all rows its predecessor kept, and all but the last return the columns that
documents has.  Rows may repeat after mixing; packing treats each of them as a document.  Null and empty texts
pass every stage that does not reject them by score; of near-copies, texts without words included,
one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravane.llm import mixing, nearcopies, packing, quality, toxicity
from terravane.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.ratings_of(table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, at a similarity of 0.8 over five-word shingles, stays."""
    return nearcopies.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a training sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]

#: SQL cannot express the learned stages and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
