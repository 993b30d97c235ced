"""Training-data pipeline over ``documents``: language ID, n-gram Jaccard
join, benchmark decontamination, PII masking, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet in the shared folder and read again as the next stage's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import stages
from vigil.session import checkpoint_dir, materialize, ship_package

STAGES = [
    ("language_id", stages.language_id),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("pii", stages.pii),
    ("byte_level_bpe", stages.byte_level_bpe),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
