"""Queries of this subpackage: op1 to op10 and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, html_extract, lm_score, mixing, near_dedup, quality_knn, quality_rules, secrets, sharding, toxicity
from quarry.llm._common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(read(spark, sf_dir, "documents"), width=3, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    mine = (op1_mixing, op2_quality_rules, op3_html_extraction, op4_lm_scoring, op5_toxicity, op6_decontamination, op7_quality_classifier, op8_secret_scans, op9_sharding, op10_near_dedup, pipeline)
    return {f.__name__: f for f in mine}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL}
