"""All registered queries of the library."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from tracklake.plans.registry import QUERIES, SQL, Query

MODULES = ("artist_queries", "build_queries", "retrieve_queries", "metric_queries", "sequence_queries", "learn_queries", "intent_queries", "source_queries", "generate_queries", "report_queries")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tracklake.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["p1_artist_rows"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
