"""Registry of named queries: one per operator of the inventory.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` over the driver tables plus,
where the semantics are SQL-expressible, the equivalent DuckDB SQL used as an oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return deco


# Text-heavy tables and their entity keys: spread when under-partitioned (see scan.spread).
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


class Tables:
    """Lazy accessor: ``T(spark, sf_dir).conversations``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from ..session import apply_workarounds, ship_package
        self._spark, self._dir = spark, sf_dir
        apply_workarounds(spark)
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        df = load(self._spark, self._dir, name)
        if name in SPREAD_KEYS:
            from ..operators.scan import spread
            df = spread(df, SPREAD_KEYS[name])
        return df


def _load_all_modules() -> None:
    from . import (chunk_jobs, curate_jobs, dialog_jobs, html_jobs, memory_jobs, quality_jobs,  # noqa: F401
                   retrieval_jobs, scene_jobs, source_jobs, stream_jobs, text_jobs, url_jobs)


def queries() -> dict[str, QueryFn]:
    _load_all_modules()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all_modules()
    return dict(_SQL)
