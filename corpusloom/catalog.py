"""Registered queries of the engine's own operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import catalog_jobs, catalog_more, catalog_retrieval, catalog_text
from corpusloom.session import code_path

Query = Callable[[SparkSession, str], DataFrame]

CATALOG = catalog_retrieval.CATALOG | catalog_text.CATALOG | catalog_jobs.CATALOG | catalog_more.CATALOG


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        code_path(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {k: _ready(q) for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
