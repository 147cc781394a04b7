"""Registry of checked queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None, using: str = ""):
    """Register ``fn(spark, sf)``; ``using`` names the shared SQL views ``sql`` reads."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            ORACLE[name] = views_sql.with_views(using.split(), sql)
        return fn

    return add
