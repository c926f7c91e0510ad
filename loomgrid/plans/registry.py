"""All queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import algebra_queries, boost_queries, kernel_queries, metric_queries, model_queries, more_queries, panel_queries, relation_queries, scalar_queries, selection_queries, series_queries, source_queries, space_queries, split_queries  # noqa: F401
from .catalog import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
