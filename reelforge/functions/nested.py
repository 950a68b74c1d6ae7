"""Nested data: JSON records, arrays, maps and vectors.

All built on ``from_json`` / ``explode`` / ``inline`` / array functions; an
empty list never fails in ANSI mode because elements are read with ``get``
(null when out of range) instead of ``[]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALBUMS_SCHEMA = "struct<albums: struct<items: array<struct<id: string, name: string, total_tracks: int>>>>"
PLAYLIST_SCHEMA = ("struct<tracks: struct<items: array<struct<track: struct<name: string, "
                   "artists: array<struct<name: string>>, external_urls: struct<spotify: string>>>>>>")


def json_records(df: DataFrame, json_col: str, schema: str, path: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """L1: parse a JSON document and turn the array at ``path`` into rows."""
    doc = F.from_json(F.col(json_col), schema)
    arr = doc
    for p in path:
        arr = arr[p]
    return df.select(*keep, F.explode_outer(arr).alias("_r")).filter(F.col("_r").isNotNull()).select(*keep, "_r.*")


def playlist_tracks(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """L2: one row per playlist track: track name, first artist (null when
    the artist list is empty), Spotify URL."""
    items = F.from_json(F.col(json_col), PLAYLIST_SCHEMA)["tracks"]["items"]
    t = df.select(*keep, F.posexplode(items).alias("track_pos", "_i"))
    tr = F.col("_i")["track"]
    return t.select(*keep, "track_pos", tr["name"].alias("track_name"),
                    F.get(tr["artists"], 0)["name"].alias("artist"),
                    tr["external_urls"]["spotify"].alias("url"))


def first_map_key(m: Column | str) -> Column:
    """L3: first key of a map (insertion order of the parsed document)."""
    c = F.col(m) if isinstance(m, str) else m
    return F.get(F.map_keys(c), 0)


def concat_vectors(*cols: Column | str) -> Column:
    """L4: vector concatenation / append (scalars are appended as 1-element arrays)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat(*parts)


def vector_to_columns(vec: str, names: Sequence[str]) -> list[Column]:
    """Dense vector -> named columns (``get``: null when the vector is short)."""
    return [F.get(F.col(vec), i).alias(n) for i, n in enumerate(names)]


def columns_to_vector(names: Sequence[str], out: str = "vector") -> Column:
    """Named columns -> dense vector."""
    return F.array(*[F.col(n) for n in names]).alias(out)
