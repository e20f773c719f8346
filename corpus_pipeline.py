"""Training-data pipeline: each stage works on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the kept rows with the columns of ``documents``, the last one the
packed pieces.  ``run`` applies them in order, writing each result to the
shared folder and reading it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohorta.llm import decontamination, language_id, near_dup, packing, quality_rules
from cohorta.llm.queries import LANGUAGE_VOCAB, WORD_VOCAB, table
from cohorta.llm.scratch import ready, stored
from cohorta.llm.tokenizer import public_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ready(spark)
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    ready(spark)
    return language_id.keep_identified(docs, public_path(LANGUAGE_VOCAB))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    ready(spark)
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences."""
    ready(spark)
    return packing.pack_sequences(docs, public_path(WORD_VOCAB))


STAGES = [("quality_rules", rules), ("language_id", language), ("near_dedup", near_duplicates),
          ("decontamination", decontaminate), ("best_fit_packing", pack)]

#: The stages are iterative or need a tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
