"""Registry of named queries: Spark callable + DuckDB oracle text.

Each entry maps a §2 operator (or a composition of them) to
``fn(spark, sf_dir) -> DataFrame`` and, where SQL can express it, an oracle
statement.  Modules under ``merchlens.plans.q_*`` register entries on import.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, ids)
        return fn
    return deco


def _load_all() -> None:
    from merchlens.plans import (q_analytics, q_models, q_quality, q_rag, q_retrieval,  # noqa: F401
                                 q_sources, q_stream, q_tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: e.fn for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: e.sql for k, e in REGISTRY.items() if e.sql}
