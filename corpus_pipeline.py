"""The corpus pipeline: five operators, each stage over all that the one before it kept.

quality classifier -> near-duplicates -> substring dedup -> benchmark decontamination -> SentencePiece ids. Each stage
is written as Parquet in the shared folder and read again, so a lost executor costs one stage's tasks. Null texts are
scored by the model's bias alone and have no ids; an empty table gives an empty result; columns besides doc_id and text
pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evgraph.llm.common import table, written
from evgraph.llm.decontaminate import decontamination_stage
from evgraph.llm.near_dup import near_dup_stage
from evgraph.llm.quality import quality_stage
from evgraph.llm.sentencepiece_scan import sentencepiece_stage
from evgraph.llm.substring_dedup import substring_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("near_duplicates", near_dup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: No stage can be put in SQL; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their token ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
