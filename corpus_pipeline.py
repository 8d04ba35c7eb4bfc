"""The corpus pipeline: quality, toxicity, near-duplicates, packing; each stage takes the documents its predecessor kept.

`run` applies the stages to the documents of a folder, each stage's result written as Parquet in the cluster's shared
folder and read again. All stages but the last return the columns of documents. No SQL states them: the tests hold
each stage, and the run, against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marklake.llm.common import stored, table
from marklake.llm.near_duplicates import one_of_each
from marklake.llm.packing import packed_sequences
from marklake.llm.quality import without_poor
from marklake.llm.toxicity import without_toxic


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; hosts are sources, their paths languages."""
    return without_poor(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more over shingles of five words: the one of the smallest id."""
    return one_of_each(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in sequences of at most 2048 tokens."""
    return packed_sequences(docs, added=True)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("near-duplicates", without_near_duplicates),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
