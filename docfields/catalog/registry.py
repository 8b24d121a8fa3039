"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docfields.catalog.views import Views, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None, recursive: bool = False):
    """Register ``fn(views) -> DataFrame``; ``sql`` is the DuckDB text over the named views."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = with_views(sql, views or [], recursive)
        return fn

    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from docfields.catalog import load_all

    load_all()


def avg4(expr: str, digits: int = 4) -> str:
    """SQL of ``exact_avg``: decimal average rounded half-up."""
    return f"round(avg(CAST({expr} AS DECIMAL(18,8))) + 1e-10, {digits})"


def pct(part: str, whole: str, digits: int = 2) -> str:
    """SQL of ``percent``; the small addend keeps ties (x.xx5) on the half-up side."""
    return f"round(100.0 * ({part}) / nullif({whole}, 0) + 1e-10, {digits})"
