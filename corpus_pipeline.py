"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import stages
from wayline.session import table, written

STAGES = [
    ("toxicity", stages.toxicity_filter),
    ("line dedup", stages.line_dedup),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("secret scans", stages.secret_redaction),
    ("packing", stages.pack_sequences),
]

#: Learned scores and edit distances have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
