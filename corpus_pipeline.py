"""Corpus pipeline: documents to shards, each stage a training-data operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furlong.llm.common import read_table, store
from furlong.llm.decontamination import stage_decontamination
from furlong.llm.language import stage_language
from furlong.llm.mixing import stage_mixing
from furlong.llm.sharding import stage_sharding
from furlong.llm.simhash import stage_simhash

STAGES = [
    ("language_id", stage_language),
    ("simhash_near_dedup", stage_simhash),
    ("benchmark_decontamination", stage_decontamination),
    ("source_mixing", stage_mixing),
    ("sharding", stage_sharding),
]

#: Hash fingerprints, learnt models and slot maps have no SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
