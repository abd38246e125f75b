"""All registered queries with their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, flows, graphs, landed, news, records, relational, retrieval, texts, tools, values

MODULES = (relational, aggregates, texts, retrieval, news, records, values, flows, graphs, landed, tools)
FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
