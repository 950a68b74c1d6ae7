"""Pluggable per-item extractors: the only place Arrow UDFs run.

The original resolves extractor classes by name and calls them per file.
Here an extractor is a registered ``pandas -> pandas`` function applied per
item with ``applyInPandas`` (items are independent, so Spark spreads them
over all tasks); its output is a table that the set-based operators pool
further.  Extractors whose work is expressible in Spark SQL are written as
operators instead (W16-W18, A5-A13, M1-M16).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Extractor = Callable[[pd.DataFrame], pd.DataFrame]
_EXTRACTORS: dict[str, tuple[Extractor, str]] = {}


def register_extractor(name: str, schema: str):
    """Decorator: make ``fn`` available as ``name`` with output ``schema``."""
    def deco(fn: Extractor) -> Extractor:
        _EXTRACTORS[name] = (fn, schema)
        return fn
    return deco


def extractor(name: str) -> tuple[Extractor, str]:
    if name not in _EXTRACTORS:
        raise KeyError(f"unknown extractor {name!r}; known: {sorted(_EXTRACTORS)}")
    return _EXTRACTORS[name]


def extract_with(df: DataFrame, key: str, name_or_fn: str | Extractor, schema: str | None = None) -> DataFrame:
    """Run an extractor once per ``key`` (one file / clip / piece) over that
    item's rows.  Extraction failures are the extractor's to report as rows
    (see Q3 for the quarantine split)."""
    if isinstance(name_or_fn, str):
        fn, schema = extractor(name_or_fn)
    else:
        fn = name_or_fn
        if schema is None:
            raise ValueError("schema is required for an unregistered extractor")
    return df.groupBy(key).applyInPandas(fn, schema)


@register_extractor("sample_energy", "item_id long, n long, energy double")
def _sample_energy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Example extractor: mean energy of a sampled signal column ``x``."""
    x = pdf["x"].astype("float64")
    return pd.DataFrame({"item_id": [int(pdf["item_id"].iloc[0])], "n": [len(x)],
                         "energy": [float((x * x).mean()) if len(x) else 0.0]})
