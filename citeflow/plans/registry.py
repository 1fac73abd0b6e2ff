"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .oracle_views import with_views

_MODULES = (
    "citeflow.plans.recall_job",
    "citeflow.plans.label_job",
    "citeflow.plans.search_job",
    "citeflow.plans.text_job",
    "citeflow.plans.io_job",
    "citeflow.plans.stream_job",
)


def _shipped(fn: Callable) -> Callable:
    """The query, with the package made importable in the Python workers first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    for m in _MODULES:
        for k, fn in importlib.import_module(m).QUERIES.items():
            out[k] = _shipped(fn)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        for k, body in importlib.import_module(m).ORACLE.items():
            out[k] = with_views(body)
    return out
