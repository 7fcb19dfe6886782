"""Registered queries: each a function of the atlas, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..sources.atlas import Atlas, over_atlas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", plain: bool = False) -> Callable:
    """Register a function of an Atlas under its own name. sql is a query over the atlas, or over the tables if plain."""

    def registered(f: Callable[[Atlas], DataFrame]) -> Callable[[Atlas], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Atlas(spark, folder))

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql if plain else over_atlas(sql, more)
        return f

    return registered
