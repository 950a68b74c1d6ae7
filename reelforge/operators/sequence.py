"""Skew-safe sequence primitives.

A window ``partitionBy(key).orderBy(t)`` sends every row of a key to one
task; if one key holds a third of the data, that task does a third of the
work.  These helpers give the same answers with work split below the key:

* :func:`sequence_index` - dense 0-based position per key, numbered inside
  (key, bucket) groups plus a prefix sum over the small per-bucket counts.
* :func:`neighbour_window` - values of the rows at positions ``-r..+r``
  around each row, from ``lag`` / ``lead`` over (key, block of positions)
  windows with ``r`` halo rows copied across every block edge.
* :func:`ranked_values` - exact value ranks inside a group from value counts
  and prefix sums over cells cut at values of the group.
* :func:`blocked_running_sum` - running sum over positions per key, computed
  per (key, block) with carried block totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                   out: str = "idx") -> DataFrame:
    """Dense 0-based position of each row in its key's order.  ``bucket``
    must be non-decreasing along ``order`` inside a key."""
    k = list(keys)
    d = df.withColumn("_b", bucket)
    local = F.row_number().over(Window.partitionBy(*k, "_b").orderBy(*order)) - 1
    counts = d.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select(*k, "_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (d.withColumn("_l", local).join(offs, [*k, "_b"])
            .withColumn(out, (F.col("_off") + F.col("_l")).cast("long")).drop("_b", "_l", "_off"))


def blocked_running_sum(df: DataFrame, keys: Sequence[str], idx: str, value: Column, out: str,
                        block_rows: int = 1 << 20) -> DataFrame:
    """``out`` = sum of ``value`` over positions ``<= idx`` of the same key,
    computed per (key, block of ``block_rows`` positions) with carried totals."""
    k = list(keys)
    d = df.withColumn("_v", value).withColumn("_blk", F.floor(F.col(idx) / block_rows))
    local = F.sum("_v").over(Window.partitionBy(*k, "_blk").orderBy(idx)
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tot = d.groupBy(*k, "_blk").agg(F.sum("_v").alias("_tot"))
    carry = tot.select(*k, "_blk", F.coalesce(F.sum("_tot").over(
        Window.partitionBy(*k).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    return (d.withColumn("_loc", local).join(carry, [*k, "_blk"])
            .withColumn(out, (F.col("_c") + F.col("_loc")).cast("long")).drop("_v", "_blk", "_loc", "_c"))


#: Distinct values that a cell of a group has on average; cells of a group at most.
CELL_VALUES, MOST_CELLS = 1 << 16, 4096


def ranked_values(df: DataFrame, group: Sequence[str], value: str, cell_values: int = CELL_VALUES) -> DataFrame:
    """One row per distinct (group, value) with its count ``_c``, the number
    of smaller values of the group ``_before``, and the group's number of rows
    ``_n`` and ``mean``; nulls left out.

    Counting comes first, so a value that fills a group is combined inside the
    map tasks, and everything else works on the counts: the source is read
    once.  A group's distinct values are then cut at splitters drawn from
    themselves, those with the smallest hashes, as many as its number of
    values asks for; an outlier or an infinity moves no other cut.  A running
    count inside (group, cell) plus the counts of the cells before it ranks
    each value, and no task holds a group.  Every task and every run draws the
    same splitters."""
    g = list(group)
    v = F.col(value)
    counts = (df.where(v.isNotNull()).select(*g, value).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_h", F.shiftrightunsigned(F.xxhash64(value), 1) / float(1 << 63)))
    stats = counts.groupBy(*g).agg(F.sum("_c").alias("_n"), (F.sum(v * F.col("_c")) / F.sum("_c")).alias("mean"),
                                   F.count(F.lit(1)).alias("_d"))
    known = counts.join(stats, g)
    wanted = F.least(F.floor(F.col("_d") / cell_values), F.lit(MOST_CELLS - 1))
    cuts = (known.where(F.col("_h") * F.col("_d") < wanted).groupBy(*g)
            .agg(F.array_sort(F.collect_list(value)).alias("_cuts")))
    # The number of cuts at or below the value, by halving steps.
    steps = F.array(*[F.lit(1 << i) for i in range(MOST_CELLS.bit_length(), -1, -1)])
    cell = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get("_cuts", at + step - 1) <= v, F.lit(False)), at + step).otherwise(at))
    dealt = (known.join(cuts, g, "left").withColumn("_cell", F.when(F.col("_cuts").isNull(), 0).otherwise(cell))
             .drop("_cuts", "_h", "_d"))
    totals = dealt.groupBy(*g, "_cell").agg(F.sum("_c").alias("_t"))
    upto = Window.partitionBy(*g).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(*g, "_cell", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*g, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_l", F.coalesce(F.sum("_c").over(local), F.lit(0))).join(first, [*g, "_cell"])
            .withColumn("_before", F.col("_off") + F.col("_l")).drop("_l", "_off", "_cell"))


def neighbour_window(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], radius: int,
                     block_rows: int = 1 << 16) -> DataFrame:
    """Values of the rows ``1..radius`` positions before / after each row
    (``<c>_m<j>`` / ``<c>_p<j>``, null beyond the ends) with about one copy
    of the data: dense positions are cut into blocks of ``block_rows``; the ``radius``
    edge rows of every block are also sent to the adjacent block as halo
    rows, so ``lag`` / ``lead`` inside (key, block) windows see across block
    edges.  Halo rows are dropped afterwards; the result keeps the column
    ``_blk`` (partitioned by key and block) for follow-up windows."""
    if block_rows < radius:
        raise ValueError("block_rows must be at least the radius")
    k = list(keys)
    pos = F.col(idx)
    blk = F.floor(pos / block_rows)
    # A row goes to its block and, near an edge, to the block beyond it: one projection, one exchange.
    blocks = F.array_compact(F.array(blk, F.when(pos % block_rows < radius, blk - 1),
                                     F.when(pos % block_rows >= block_rows - radius, blk + 1)))
    u = df.withColumn("_blk", F.explode(blocks)).withColumn("_halo", F.col("_blk") != blk)
    w = Window.partitionBy(*k, "_blk").orderBy(idx)
    out = {}
    for c in cols:
        for j in range(1, radius + 1):
            out[f"{c}_m{j}"] = F.lag(c, j).over(w)
            out[f"{c}_p{j}"] = F.lead(c, j).over(w)
    return u.withColumns(out).filter(~F.col("_halo")).drop("_halo")
