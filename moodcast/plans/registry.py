"""Registered queries: each builds the fixture tables from the driver's data at
``sf_dir`` and runs one engine operator over the whole of them. ``ORACLE``
holds the same computation in DuckDB SQL (same column names)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moodcast.sources.fixtures import Fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixture(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from moodcast.plans import queries_boundaries, queries_core, queries_delta, queries_history, queries_markup, queries_memo, queries_phrases, queries_read, queries_text, queries_write  # noqa: F401
