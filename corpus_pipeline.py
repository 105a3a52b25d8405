"""Corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import stages
from fathom.llm.common import materialise, table

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard", stages.ngram_jaccard),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: The trained classifier of the first stage has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
