"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` over
the given tables, optionally paired with an equivalent DuckDB SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB oracle (None =
    rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    from . import (  # noqa: F401  (import for registration side effects)
        q_aggregates,
        q_cleaning,
        q_encode_scale,
        q_evaluate,
        q_features,
        q_io_select_stream,
        q_models,
        q_splits,
    )
    return dict(QUERIES), dict(ORACLE)
