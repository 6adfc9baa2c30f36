"""All queries of the engine and their SQL twins, gathered from the ``plans`` modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
PLANS = ("features", "retrieval", "build", "joins", "metrics", "ordered", "scalars", "events", "curation", "shaping", "validation", "loading", "reports")


def query(sql: str | None = None) -> Callable:
    """Register a plan ``(spark, sf_dir) -> DataFrame`` under its name, with its DuckDB twin."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in PLANS:
        import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
