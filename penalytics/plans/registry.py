"""Registry of named queries: (spark, sf_dir) -> DataFrame, plus DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: QueryFn
    oracle: str | None
    ids: tuple[str, ...]
    headline: bool


_QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, ids: tuple[str, ...] = (),
             headline: bool = False) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Query(name, fn, oracle, tuple(ids), headline)
        return fn
    return wrap


def all_queries() -> dict[str, Query]:
    from . import catalog  # noqa: F401  (registers on import)
    return dict(_QUERIES)
