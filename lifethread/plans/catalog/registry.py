"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifethread.plans.bindings import Tables, oracle

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(tables) -> DataFrame`` under ``name``; without ``sql`` only its rows are checked."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = oracle(sql)
        return f

    return keep


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _load() -> None:
    from lifethread.plans.catalog import files, groups, joins, ordered, scalar, search, state  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    bind = lambda f: lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return {name: bind(f) for name, f in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
