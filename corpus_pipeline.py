"""The corpus pipeline: each stage reads all that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontam, langid, quality, simhash, spm

STAGES = [
    ("language", langid.language_stage),
    ("quality", quality.quality_stage),
    ("near_dedup", simhash.near_dedup_stage),
    ("decontamination", decontam.decontamination_stage),
    ("sentencepiece", spm.encoding_stage),
]

#: Trained classifiers, fingerprints and alignment can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's result is written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
