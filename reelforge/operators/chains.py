"""Greedy chains over time (W11) without a sequential pass over a key.

A candidate is accepted when it is more than ``min_gap`` after the last
accepted one (the first reference point is 0).  What a stretch of time does to
that reference point is a small table: for every candidate that may be the
first accepted one in it (``first``), the last one accepted then (``last``).
Only candidates within one gap of the stretch's beginning can be first, plus
the next one; and tables of neighbouring stretches compose to one table.

1. Each block of ``span`` (many gaps) gives its table.
2. Tables of ``fan`` neighbours are composed, level by level, so that a key
   with very many blocks is composed in many tasks.
3. The few tables of the top level are walked from the beginning; each level
   down receives the reference points at its stretches' beginnings.
4. Inside a block the accepted rows follow from its reference point.

It is one lazy plan: no job runs while it is built, and the rows that meet in
a group are the distinct times of one span, or ``fan`` tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block covers this many gaps; so many stretches make one of the next level; levels of composition.
GAPS, FAN, LEVELS = 64, 64, 2


def _accept(reference: Column, times: Column, gap: int) -> Column:
    """The reference point after walking over sorted ``times``."""
    return F.aggregate(times, reference, lambda last, t: F.when(t > last + gap, t).otherwise(last))


def _through(reference: Column, table: Column, gap: int) -> Column:
    """The reference point behind a stretch, from the one before it."""
    hit = F.filter(table, lambda e: e["first"] > reference + gap)
    return F.coalesce(F.get(hit, F.lit(0))["last"], reference)


def _walk(reference: Column, tables: Column, gap: int) -> Column:
    return F.aggregate(tables, reference, lambda last, t: _through(last, t["table"], gap))


def _block_table(times: Column, begin: Column, gap: int) -> Column:
    near = F.size(F.filter(times, lambda t: t <= begin + gap))
    return F.transform(F.slice(times, F.lit(1), near + 1),
                       lambda t: F.struct(t.alias("first"), _accept(t, times, gap).alias("last")))


def _composed(tables: Column, gap: int) -> Column:
    """One table of several in order: whatever can be first in the first
    stretch, or else the earliest of the second one (a stretch is longer than
    a gap, so nothing before it keeps that one from being accepted)."""
    def led_by(i: int, entries: Column) -> Column:
        rest = F.slice(tables, F.lit(i + 2), F.greatest(F.size(tables) - (i + 1), F.lit(0)))
        return F.transform(entries, lambda e: F.struct(
            e["first"].alias("first"), _walk(e["last"], rest, gap).alias("last")))

    second = F.slice(F.coalesce(F.get(tables, F.lit(1))["table"], F.slice(F.get(tables, F.lit(0))["table"], F.lit(1),
                                                                         F.lit(0))), F.lit(1), F.lit(1))
    return F.concat(led_by(0, F.get(tables, F.lit(0))["table"]), led_by(1, second))


def _with_entries(reference: Column, tables: Column, gap: int) -> Column:
    """(block, reference point before it) for stretches in order."""
    empty = F.slice(F.transform(tables, lambda t: F.struct(t["block"].alias("block"), reference.alias("entry"))),
                    F.lit(1), F.lit(0))
    start = F.struct(reference.alias("last"), empty.alias("entries"))
    done = F.aggregate(tables, start, lambda acc, t: F.struct(
        _through(acc["last"], t["table"], gap).alias("last"),
        F.concat(acc["entries"], F.array(F.struct(t["block"].alias("block"), acc["last"].alias("entry")))).alias("entries")))
    return done["entries"]


def accept_with_gap_blocks(candidates: DataFrame, keys: Sequence[str], ts: str, min_gap: int,
                           span: int | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """W11 greedy gap: ``keys..., ts`` of the accepted candidates.

    A null time is never accepted and repeated candidates count once; null
    keys are a key of their own."""
    span = span or GAPS * min_gap
    if span <= min_gap:
        raise ValueError("a block must be longer than the gap")
    k = list(keys)
    t = F.col(ts).cast("long")
    # Nothing up to one gap after the reference point 0 can ever be accepted.
    blocks = (candidates.where(t > min_gap).select(*k, t.alias("_t")).withColumn("_b0", F.floor(F.col("_t") / span))
              .groupBy(*k, "_b0").agg(F.sort_array(F.collect_set("_t")).alias("_times")))
    tables = [blocks.select(*k, "_b0", _block_table(F.col("_times"), F.col("_b0") * span, min_gap).alias("table"))]

    def gathered(level: int, by: list[str]) -> DataFrame:
        """The tables of a level, in order, for each stretch of the next one."""
        own = F.struct(F.col(f"_b{level}").alias("block"), "table")
        return tables[level].groupBy(*by).agg(F.sort_array(F.collect_list(own)).alias("_tables"))

    groups = []
    for level in range(1, levels + 1):
        own = tables[-1].withColumn(f"_b{level}", F.floor(F.col(f"_b{level - 1}") / fan))
        tables[-1] = own
        group = gathered(level - 1, [*k, f"_b{level}"])
        groups.append(group)
        tables.append(group.select(*k, f"_b{level}", _composed(F.col("_tables"), min_gap).alias("table")))

    def opened(df: DataFrame, entry: Column, level: int) -> DataFrame:
        return (df.select(*k, F.explode(_with_entries(entry, F.col("_tables"), min_gap)).alias("_e"))
                .select(*k, F.col("_e.block").alias(f"_b{level}"), F.col("_e.entry").alias("_entry")))

    entries = opened(gathered(levels, k), F.lit(0).cast("long"), levels)
    for level in range(levels, 0, -1):
        entries = opened(_same(groups[level - 1], entries, [*k, f"_b{level}"]), F.col("_entry"), level - 1)
    taken = F.aggregate(
        "_times", F.struct(F.col("_entry").alias("last"), F.slice("_times", F.lit(1), F.lit(0)).alias("all")),
        lambda acc, x: F.when(x > acc["last"] + min_gap, F.struct(
            x.alias("last"), F.concat(acc["all"], F.array(x)).alias("all"))).otherwise(acc))["all"]
    kind = candidates.schema[ts].dataType
    return (_same(blocks, entries, [*k, "_b0"]).select(*k, F.explode(taken).alias(ts))
            .withColumn(ts, F.col(ts).cast(kind)))


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns where null equals null."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return left.join(r, cond).drop(*[f"_r_{c}" for c in on])
