"""Registry of runnable queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, ctes


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``. ``sql`` may use the derived tables
    by name; their definitions are put in front."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(name)
        REGISTRY[name] = Query(name, run, None if sql is None else ctes(sql))
        return fn

    return wrap
