"""Registry of driver queries: name → (Spark builder, DuckDB oracle SQL or None).

Each query derives a stage's input from the driver's tables by expressions both
engines evaluate identically, runs the library stage on Spark, and returns flat,
aliased columns (BIGINT / DOUBLE rounded to 6 places / VARCHAR).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> None:
    from curatio.standins import (persona, commonsense, events, dialogue, faces,  # noqa: F401
                                  images, worklists, texts, streams, requests, stages, sources, assembly)
