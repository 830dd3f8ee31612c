"""A corpus pipeline: five stages, each one operator applied to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import read, stage_table
from rasterloom.llm.stages import dedup_spans, drop_low_quality, drop_near_copies, encode_tokens, mix

STAGES = [
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", dedup_spans),
    ("mix_sources", mix),
    ("bpe_encode", encode_tokens),
]
#: Learned rules, random rounding and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
