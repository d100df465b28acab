"""A training corpus from raw documents: identify, filter, deduplicate, decontaminate, mix.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; its
result is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of documents. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlens.llm import decontamination, language, mixing, simhash, toxicity
from rosterlens.llm.text import table
from rosterlens.session import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject; it learns from the documents that have a language."""
    return language.keep_identified(docs, language.train(docs))


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the models learn from those that have a label."""
    return toxicity.keep_ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, the one with the smallest id."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by ``copy``."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identified),
    ("toxicity", ordinary),
    ("simhash_near_dedup", distinct),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]

#: The stages learn and search iteratively; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
