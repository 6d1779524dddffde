"""Registry of named queries: Spark builder + optional DuckDB oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Builder
    sql: str | None
    ops: tuple[str, ...]
    doc: str


REGISTRY: dict[str, QuerySpec] = {}

_MODULES = (
    "caseflow.plans.q_core",
    "caseflow.plans.q_analytics",
    "caseflow.plans.q_serving",
    "caseflow.plans.q_governance",
    "caseflow.plans.q_state",
    "caseflow.plans.q_text",
    "caseflow.plans.q_search",
    "caseflow.plans.q_generate",
    "caseflow.plans.q_stream",
)


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, ops, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    for m in _MODULES:
        importlib.import_module(m)
    return REGISTRY
