"""Preparation of a training corpus: rules, classifier, near duplicates, decontamination, packing.

Defined results: a null or empty text fails the rules and goes; of repeated rows and copies one stays; null doc_ids take part like
others; extra columns go along; without labels both classifiers keep what the base rules keep; an empty benchmark
removes nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from descria.llm import compress_classifier, decontaminate, jaccard_join, packing, quality_rules
from descria.llm.common import materialise, table

#: Near duplicates of the pipeline: shingles of five words, at least four fifths of them shared. The query of op4 has its own.
SHINGLE_WORDS, LEAST_SHARED = 5, Fraction(4, 5)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality_rules.fit_quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_quality(docs, model)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; it learns from bad documents too, which ``docs`` may lack."""
    model = compress_classifier.fit_compression_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return compress_classifier.keep_scored(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_first(docs, SHINGLE_WORDS, LEAST_SHARED)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learnt scores can't be written as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
