"""Queries and oracles of the subpackage: one entry per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelforge.llm import (q_alignment, q_classifier, q_edits, q_hashing, q_licenses, q_mixing, q_neardup, q_packing,
                           q_ppm, q_repair, q_rules, q_superkmers, q_warc)

_MODULES = (q_mixing, q_ppm, q_hashing, q_edits, q_neardup, q_packing, q_warc, q_rules, q_licenses, q_classifier,
            q_alignment, q_superkmers, q_repair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in getattr(m, "ORACLES", {}).items()}
