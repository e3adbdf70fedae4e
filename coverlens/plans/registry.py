"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the given tables (or data
Spark derives from them), so its work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle() if callable(oracle) else oracle
        return fn

    return deco


def queries() -> dict[str, Builder]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    # importing the query modules fills the registry
    from coverlens.plans import queries_estimators, queries_eval, queries_extract, queries_generate, queries_grade, queries_harmonize, queries_io, queries_jobs, queries_prompts, queries_rollouts, queries_streaming  # noqa: F401
