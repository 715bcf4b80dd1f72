"""The training-data pipeline: documents to packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import queries as Q

STAGES = [
    ("quality_rules", Q.stage_quality),
    ("line_dedup", Q.stage_line_dedup),
    ("near_dedup", Q.stage_near_dedup),
    ("decontamination", Q.stage_decontaminate),
    ("packing", Q.stage_pack),
]

#: Four of the five stages have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    return Q.run_stages(STAGES, spark, sf_dir)
