"""A corpus from raw documents to packed sequences: STAGES in order, each written as Parquet and reread."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from braidseq.llm._common import drop_path, settle, table
from braidseq.llm.line_dedup import stage_line_dedup
from braidseq.llm.mixing import stage_mixing
from braidseq.llm.near_dedup import stage_near_dedup
from braidseq.llm.packing import stage_packing
from braidseq.llm.quality_rules import stage_quality

STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Near-dedup and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; pieces with the sequence and place of each. A stage's own tables, and the one
    it read, are dropped once its result is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = settle(functools.partial(stage, spark, docs, sf_dir), spark, f"stage-{name}")
        if read:
            drop_path(spark, read)
        read = path
    return docs
