"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sheetdelta.llm import op1_secrets, op2_near_dup, op6_quality, op7_packing, op9_substring
from sheetdelta.llm.common import shared_dir

STAGES = [
    ("quality rules", op6_quality.stage),
    ("near-duplicates", op2_near_dup.stage),
    ("substring dedup", op9_substring.stage),
    ("secret scans", op1_secrets.stage),
    ("packing", op7_packing.stage),
]

#: SQL cannot express signatures, concentration steps, tokens or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
