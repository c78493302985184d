"""Named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder; ``covers`` names the inventory entries it exercises."""
    def add(build: Builder) -> Builder:
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = Query(build, sql, covers)
        return build
    return add
