"""Five stages that turn raw documents into packed training sequences.

Toxic documents go, one document of each near-duplicate group stays, personal data get
surrogates, sources are mixed to target weights, and the rest is packed. Every stage is written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hintspark.llm import queries as llm
from hintspark.plans.shared import SharedTables

STAGES = [
    ("toxicity", llm.toxicity_stage),
    ("minhash_near_dedup", llm.near_dedup_stage),
    ("pii", llm.pii_stage),
    ("mixing", llm.mixing_stage),
    ("packing", llm.packing_stage),
]

#: SQL can express neither the toxicity model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in their order."""
    tables = SharedTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = tables.keep(docs)
    return docs
