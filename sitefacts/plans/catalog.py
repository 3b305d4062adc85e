"""Registry of the engine's own queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitefacts.plans import page_queries, record_queries, text_queries

_MODULES = (page_queries, text_queries, record_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_queries.site_primary_phone(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
