"""The driver queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohorta.llm import (bitpack, decontamination, divergence, hard_negatives, language_id, license_scan, lm_scoring,
                         near_dup, packing, quality_classifier, quality_rules, sharding, url_filter)
from cohorta.llm.scratch import ready
from cohorta.llm.tokenizer import public_path

LANGUAGE_VOCAB = "piece_bpe_32k.model"
BYTE_VOCAB, BYTE_VOCAB_SIZE = "byte_bpe_50k.json", 50_257
WORD_VOCAB = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"), public_path(LANGUAGE_VOCAB))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(table(spark, sf_dir, "documents"))


def op8_bit_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.bit_packed(table(spark, sf_dir, "documents"), public_path(BYTE_VOCAB), BYTE_VOCAB_SIZE)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), public_path(WORD_VOCAB))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_language_id, op3_quality_rules, op4_near_duplicates,
                            op5_decontamination, op6_quality_classifier, op7_lm_scoring, op8_bit_packed,
                            op9_license_scan, op10_best_fit_packing, op11_sharding, op12_divergence,
                            op13_hard_negatives)}
SQL: dict[str, str] = {"op1_url_filter": url_filter.verdict_sql(), "op12_divergence": divergence.divergence_sql(),
                       "op13_hard_negatives": hard_negatives.hard_negatives_sql()}
