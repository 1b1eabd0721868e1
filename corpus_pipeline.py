"""From raw documents to packed training sequences: quality rules, SimHash, substring dedup, mixing, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptspark.llm import harmonic, mixing, passages, quality, simhash
from scriptspark.llm.common import owned, release, shared_folder


def _alone(stage: Callable) -> Callable:
    """A stage that first removes what the stages before it stored on the way: their results are written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owner = f"pipeline {sf_dir}"
        release(spark, owner)
        with owned(owner):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_rules", _alone(quality.stage)),
    ("simhash_near_dedup", _alone(simhash.stage)),
    ("substring_dedup", _alone(passages.stage)),
    ("source_mixing", _alone(mixing.stage)),
    ("harmonic_packing", _alone(harmonic.stage)),
]

#: Fingerprints, links and packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
