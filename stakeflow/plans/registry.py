"""Registry of named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stakeflow.session import configure
from stakeflow.sources import Tables
from stakeflow.sources.views import oracle


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(configure(spark), sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``sql`` may use the adapter views it lists."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, oracle(views, sql) if sql else None)
        return build

    return wrap
