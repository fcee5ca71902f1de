"""The corpus pipeline: stages over documents, each written and read again by the caller or by run()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import pipeline_stages as stages
from tidemark.llm.common import mark, read, release, written

#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("bpe", stages.bpe_round_trip),
]
#: Kernel classification and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, since = read(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        release(since, docs)  # what the stage wrote on its way, and its predecessor's table
    return STAGES[-1][1](spark, docs, sf_dir)
