"""Registry of named queries: each one is a Spark builder ``(spark, sf_dir) ->
DataFrame`` plus, where the computation is expressible in SQL, an independent
DuckDB oracle statement over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None
    section: str
    bench: bool


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, bench: bool = True):
    """Register ``fn(spark, sf_dir)`` under a SURVEY §2 id."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, fn.__module__.rsplit(".", 1)[-1], bench)
        return fn
    return deco
