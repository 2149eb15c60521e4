"""Corpus pipeline: quality, repeated lines, near copies, secrets, packing.

Each stage takes what its predecessor wrote; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import lines, ngram_join, packing, quality, secrets, shared


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become their kinds in brackets."""
    return secrets.mask(docs)


STAGES = [
    ("quality", quality.stage),
    ("lines", lines.stage),
    ("near_copies", ngram_join.stage),
    ("secrets", mask_secrets),
    ("packing", packing.stage),
]

#: The classifier and the packing order are beyond SQL; tests hold the operators against plain versions, and run the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written as Parquet and reread."""
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared.written(docs, f"pipeline-{name}")
    return docs
