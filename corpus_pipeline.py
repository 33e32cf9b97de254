"""From documents to training shards: quality rules, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, mixing, near_dedup, quality_rules, sharding
from quarry.llm._common import read, stage, unstage

WIDTH, PERCENT = 5, 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, WIDTH, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs)


STAGES = [("quality_rules", rules), ("near_dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Distances to references, signatures and walks have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage_ in STAGES[:-1]:
        before, docs = docs, stage(stage_(spark, docs, sf_dir), f"pipeline_{name}")
        unstage(before)  # the documents table itself isn't a staged one
    return STAGES[-1][1](spark, docs, sf_dir)
