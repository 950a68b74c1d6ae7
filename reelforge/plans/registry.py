"""Registry of named queries: one Spark plan and (where SQL can say it) one
DuckDB oracle per operator id of the inventory."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

_MODULES = (
    "reelforge.plans.q_segments",
    "reelforge.plans.q_text",
    "reelforge.plans.q_scalar",
    "reelforge.plans.q_matching",
    "reelforge.plans.q_frames",
    "reelforge.plans.q_fingerprint",
    "reelforge.plans.q_timeline",
    "reelforge.plans.q_nested",
    "reelforge.plans.q_streams",
)


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise KeyError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLE[key] = sql
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
