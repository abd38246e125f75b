"""What all plan modules share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..ship import ship

Query = Callable[[SparkSession, str], DataFrame]


class Plans(dict):
    """name -> (query, DuckDB SQL or None)."""

    def add(self, sql: str | None = None):
        def put(fn: Query) -> Query:
            @wraps(fn)
            def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return fn(spark, sf_dir)

            self[fn.__name__] = (shipped, sql)
            return shipped

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
