"""From raw documents to packed sequences: language ID, near-dedup, substring dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as Parquet in the
shared checkpoint folder and the next stage reads them, so a lost executor costs no finished stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lithoframe.llm import langid, neardup, packing, secrets, substrings
from lithoframe.llm.common import shared_dir, table

STAGES = [
    ("language_id", langid.stage),
    ("near_dedup", neardup.stage),
    ("substring_dedup", substrings.stage),
    ("secret_scan", secrets.stage),
    ("best_fit_packing", packing.stage),
]
#: Compression, sampling and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
