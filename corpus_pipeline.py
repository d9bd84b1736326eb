"""Corpus pipeline: each stage's documents are the next one's input.

Every stage but the last returns the columns of `documents`, whichever those are; the last returns the packed
pieces. Stages look at all rows they are given, and nulls, ties and repeated rows are treated as the operator
that a stage calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontam, langid, lines, neardup, packing
from fieldloom.llm.staging import staged
from fieldloom.plans.shipping import ship_package
from fieldloom.plans.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of a language that isn't recognised, go."""
    ship_package(spark)
    return langid.with_known_language(docs)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand earlier in the corpus go, and documents of which nothing else is left."""
    ship_package(spark)
    return lines.without_repeated_lines(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    ship_package(spark)
    return neardup.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    ship_package(spark)
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("lines", unrepeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Language identification is a trained model, so SQL cannot give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
