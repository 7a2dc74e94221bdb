"""Named queries: how to build each on Spark, which operators it covers, and its reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.core import round_doubles
from ..session import tune
from .oracle import with_tables


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    body: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` names the columns the comparison rounds on both sides."""

    def wrap(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return round_doubles(fn(spark, sf_dir))

        build.__name__ = name
        build.__doc__ = fn.__doc__
        QUERIES[name] = Query(name, operators, build, with_tables(sql, doubles.split()) if sql else None, sql)
        return fn

    return wrap
