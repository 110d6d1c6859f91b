"""The registered queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans import aggregate_queries, detail_queries, extract_queries, join_queries, match_queries, merge_queries, select_queries, source_queries, stream_queries

MODULES = (select_queries, join_queries, aggregate_queries, merge_queries, match_queries, extract_queries, stream_queries, source_queries, detail_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
