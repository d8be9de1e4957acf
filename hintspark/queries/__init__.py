"""Registered queries by topic: NAME: (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
TOPICS = ("text", "retrieval", "evaluation", "splits", "evidence", "models", "heads", "traces", "sources", "families", "parsers")


def registered() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for topic in TOPICS:
        found |= import_module(f"hintspark.queries.{topic}").QUERIES
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
