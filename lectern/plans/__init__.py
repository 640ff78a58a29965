"""Named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.views import Duck, Spark, with_views

from . import frames
from .catalog import QUERIES

FLAGSHIP = "flagship_library"


def _sql(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Spark(sf_dir)
    return spark.sql(with_views(d, QUERIES[name](d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_sql, name) for name in QUERIES} | frames.queries()


def oracle_sql() -> dict[str, str]:
    d = Duck()
    return {name: with_views(d, text(d)) for name, text in QUERIES.items()} | frames.oracle_sql()
