"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule: a piecewise linear function of training
time t in [0, 1].  Its integral is the weight of the source, which fixes the
source's target (its share of the words to take, filled up to a cap by water
filling).  The schedule scaled to the target is the source's cumulative token
demand D(t); a document that begins c words into its source's stream is wanted
at the time t with D(t) = c, so inverting D gives its training position.  The
documents are then range-sorted by position.

Sources are ordered by code point, null last; schedules repeat over them.
A source's stream is its documents in the order of md5(seed:doc_id), repeated
until the target is reached.  With ``cut`` the last document of a source is
taken in part, so the source's words equal its rounded target; without it,
whole documents are taken, the last one if at least half of it fits.

Defined results: a null text has size 0; a document of size 0 is never taken
(no positions); a source without words has target 0; equal rows are separate
documents that tie (their order does not change the result); an empty table
gives an empty result; a null source is one source of its own; columns beside
the ones named are carried along (internal names begin with ``_mx_``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.llm.common import WORD

#: Weights 5, 2, 1 as integrals of a falling, a level and a rising schedule.
SCHEDULES = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)),
)
SHARE, CAP, SEED = 1.5, 2.0, "mix"
#: Cells of a source's stream; a hot source is dealt over all of them.
CELLS_HEX = 3


def integral(knots) -> float:
    """The weight of a schedule: the area under its knots."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def time_of(knots, part: Column) -> Column:
    """The t at which the integral of the schedule reaches ``part`` (0 to 1) of the whole."""
    want = part * F.lit(integral(knots))
    out, done = F.lit(float(knots[-1][0])), integral(knots)
    for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:]))):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        done -= area
        more = want - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * more))
        # The stable root of  slope / 2 * x^2 + w0 * x = more.
        inside = F.when(more <= 0, F.lit(float(t0))).otherwise(F.lit(float(t0)) + 2 * more / (F.lit(w0) + root))
        out = F.when(want < F.lit(done + area), inside).otherwise(out)
    return out


def _per_class(schedules, value) -> Column:
    out = F.lit(None)
    for i, knots in enumerate(schedules):
        out = F.when(F.col("_mx_class") == i, value(knots)).otherwise(out)
    return out


def source_targets(cells: DataFrame, schedules=SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: its words, class of schedule and target.

    Targets share ``share`` times all words by weight; a source stops at
    ``cap`` times its own words and the excess is reshared by weight until
    none is above.  That is min(cap * words, level * weight) with one level:
    sorted by cap * words / weight, the level of the first source that is not
    capped.  The windows run over sources, not documents.
    """
    by_name = Window.orderBy("_mx_null", "_mx_src")
    by_ratio = Window.orderBy("_mx_ratio", "_mx_null", "_mx_src")
    everything = Window.partitionBy(F.lit(1))
    s = (cells.groupBy("_mx_null", "_mx_src").agg(F.sum("_mx_words").alias("_mx_words"))
         .withColumn("_mx_class", (F.row_number().over(by_name) - 1) % len(schedules))
         .withColumn("_mx_weight", _per_class(schedules, lambda k: F.lit(float(integral(k)))))
         .withColumn("_mx_cap", F.col("_mx_words") * F.lit(float(cap)))
         .withColumn("_mx_ratio", F.col("_mx_cap") / F.col("_mx_weight"))
         .withColumn("_mx_wish", F.sum("_mx_words").over(everything) * F.lit(float(share))))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col("_mx_wish") - F.coalesce(F.sum("_mx_cap").over(before), F.lit(0.0)))
             / F.sum("_mx_weight").over(after))
    s = s.withColumn("_mx_level", level)
    level = F.min(F.when(F.col("_mx_level") <= F.col("_mx_ratio"), F.struct("_mx_ratio", "_mx_level"))).over(everything)
    return (s.withColumn("_mx_level", level["_mx_level"])
            .withColumn("_mx_target", F.coalesce(F.least("_mx_cap", F.col("_mx_level") * F.col("_mx_weight")),
                                                 F.col("_mx_cap")))
            .select("_mx_null", "_mx_src", "_mx_words", "_mx_class", "_mx_target"))


def curriculum(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
               schedules=SCHEDULES, share: float = SHARE, cap: float = CAP, cut: bool = True,
               seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """The documents with ``_mx_size``, ``_mx_words`` (of the source),
    ``_mx_target`` and ``_mx_turns``: an array of (position, words) in which
    the mix takes the document.  ``keep`` lists the columns to carry (all by
    default); only these reach the shuffle."""
    keep = docs.columns if keep is None else keep
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = docs.select(
        *[F.col(c) for c in keep],
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_mx_size"),
        F.col(source_col).isNull().alias("_mx_null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_mx_src"),
        key.alias("_mx_key"),
        F.substring(key, 1, CELLS_HEX).alias("_mx_cell"))
    cells = (sized.groupBy("_mx_null", "_mx_src", "_mx_cell").agg(F.sum("_mx_size").alias("_mx_words")))
    stream = Window.partitionBy("_mx_null", "_mx_src").orderBy("_mx_cell")
    begins = cells.select("_mx_null", "_mx_src", "_mx_cell", F.coalesce(
        F.sum("_mx_words").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_mx_begin"))
    sources = source_targets(cells, schedules, share, cap)
    cell = Window.partitionBy("_mx_null", "_mx_src", "_mx_cell").orderBy("_mx_key", "_mx_size")
    placed = (sized.join(begins.join(sources, ["_mx_null", "_mx_src"]), ["_mx_null", "_mx_src", "_mx_cell"])
              .withColumn("_mx_begin", F.col("_mx_begin") + F.coalesce(
                  F.sum("_mx_size").over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    turns = []
    for turn in range(math.ceil(cap)):
        begin = F.col("_mx_begin") + turn * F.col("_mx_words")
        size, goal = F.col("_mx_size"), F.round("_mx_target").cast("long")
        words = (F.greatest(F.lit(0), F.least(size, goal - begin)) if cut
                 else F.when(begin + size / 2 <= goal, size).otherwise(0)).cast("long")
        part = F.when(F.col("_mx_target") > 0, begin / F.col("_mx_target")).otherwise(0.0)
        turns.append(F.struct(_per_class(schedules, lambda k, p=part: time_of(k, p)).alias("position"),
                              words.alias("words")))
    return placed.select(*keep, "_mx_size", "_mx_words", "_mx_target",
                         F.filter(F.array(*turns), lambda t: t["words"] > 0).alias("_mx_turns"))


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per turn of a document, range-sorted by position."""
    names = [c for c in columns]
    flat = mixed.select(*names, F.explode("_mx_turns").alias("_mx_turn"))
    return (flat.repartitionByRange(F.col("_mx_turn.position"))
            .sortWithinPartitions("_mx_turn.position").select(*names))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: whole documents, repeated as often as taken, in training order."""
    return training_order(curriculum(docs, cut=False), docs.columns)
