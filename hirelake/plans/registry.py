"""Registered queries over the driver's tables, each with an independent
DuckDB SQL oracle.  ``__spark_entry__`` exposes these two dictionaries.

Every query reads whole tables; the only limits are the top-10 reports,
where the limit is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Add a query under ``name``; ``oracle`` is its DuckDB SQL (omit it
    for operators SQL cannot express)."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from hirelake.plans import (  # noqa: F401
        queries_metrics,
        queries_quality,
        queries_io,
        queries_rate,
    )
