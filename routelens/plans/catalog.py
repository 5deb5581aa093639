"""Registry of the queries that bind operators to the test tables.

Each query is registered with its DuckDB oracle SQL (or ``None`` when the
operator is not SQL-expressible, e.g. grouped-Python assignment). Plans import
this module and decorate builders; ``__spark_entry__`` exposes the registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql.strip()
        return fn

    return deco


_MADE: dict[tuple[str, str, str], object] = {}


def made_once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], object]) -> object:
    """What ``make`` wrote for this input, made by the first query of an application that asks for it.

    For written intermediate results (staged tables, documents) that several queries read.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _load_all() -> None:
    # import side effect: every plan module registers its queries
    import importlib
    import pkgutil

    import routelens.plans as pkg

    for m in sorted(pkgutil.iter_modules(pkg.__path__), key=lambda m: m.name):
        if m.name not in ("catalog", "sqlbits"):
            importlib.import_module(f"routelens.plans.{m.name}")


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
