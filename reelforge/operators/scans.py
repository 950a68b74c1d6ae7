"""Segmented scans: running values of an associative operator in two levels.

A window over a whole key sends the key to one task.  Here a key's rows are
cut into blocks that follow its order; a window runs inside (key, block), one
row per block carries what the block adds (sum, maximum, last value), a window
over these few rows gives each block what came before it, and a join on (key,
block) puts both together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_blk"


def segmented_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                   scans: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add running values; ``block`` must not decrease along ``order``.

    ``scans`` maps a new column to (kind, value):

    * ``sum``: sum up to and with the row (nulls add nothing);
    * ``max_before``: maximum of the rows before (null: none);
    * ``last_before``: value of the row before (it may be null);
    * ``known_before``: last value before that is not null.

    Null keys and null blocks are groups like others.  The block stays as
    ``_blk``, for aggregates on the same partitioning."""
    k = [*keys, BLOCK]
    d = df.withColumn(BLOCK, block).withColumns({f"_v_{c}": v for c, (_, v) in scans.items()}).repartition(*k)
    inside = Window.partitionBy(*k).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local, total, carry = {}, [], {}
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    for c, (kind, _) in scans.items():
        v = F.col(f"_v_{c}")
        if kind == "sum":
            local[f"_l_{c}"] = F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            total.append(F.sum(v).alias(f"_t_{c}"))
            carry[f"_c_{c}"] = F.sum(f"_t_{c}").over(earlier)
        elif kind == "max_before":
            local[f"_l_{c}"] = F.max(v).over(before)
            total.append(F.max(v).alias(f"_t_{c}"))
            carry[f"_c_{c}"] = F.max(f"_t_{c}").over(earlier)
        elif kind == "last_before":
            local[f"_l_{c}"] = F.lag(F.struct(v.alias("v"))).over(inside)
            total.append(F.max_by(F.struct(v.alias("v")), place).alias(f"_t_{c}"))
            carry[f"_c_{c}"] = F.lag(f"_t_{c}").over(blocks)
        elif kind == "known_before":
            local[f"_l_{c}"] = F.last(v, ignorenulls=True).over(before)
            total.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_t_{c}"))
            carry[f"_c_{c}"] = F.last(f"_t_{c}", ignorenulls=True).over(earlier)
        else:
            raise ValueError(f"unknown scan {kind!r}")
    carried = d.groupBy(*k).agg(*total).withColumns(carry)
    carried = carried.select(*[F.col(c).alias(f"_k_{c}") for c in k], *carry)
    on = None
    for c in k:
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        on = one if on is None else on & one
    joined = d.withColumns(local).join(carried, on)
    out = {}
    for c, (kind, _) in scans.items():
        here, came = F.col(f"_l_{c}"), F.col(f"_c_{c}")
        if kind == "sum":
            zero = F.lit(0).cast(joined.schema[f"_l_{c}"].dataType)
            out[c] = F.coalesce(came, zero) + F.coalesce(here, zero)
        elif kind == "max_before":
            out[c] = F.greatest(came, here)
        elif kind == "last_before":
            out[c] = F.coalesce(here, came)["v"]
        else:
            out[c] = F.coalesce(here, came)
    return joined.select(*[c for c in df.columns if c not in out and c != BLOCK], *[v.alias(c) for c, v in out.items()],
                         BLOCK)
