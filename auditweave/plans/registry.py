"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, more_queries, project_queries, report_queries, rule_queries, store_queries, text_queries
from ..storage import findable
from .roles import Roles, with_roles

_ALL = {**graph_queries.QUERIES, **project_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES, **report_queries.QUERIES, **rule_queries.QUERIES, **store_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            findable(spark)
            return make(Roles(spark, sf_dir))

        return run

    return {name: over(make) for name, (make, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_roles(sql) for name, (_, sql) in _ALL.items() if sql}
