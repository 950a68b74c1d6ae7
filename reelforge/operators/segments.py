"""Label-sequence segmentation.

Input: one row per fixed-length chunk of a timeline, carrying a (possibly
null) recognised label and an offset, e.g. the chunk-match table

    video_id, start, end, song_id, offset_seconds

The operators smooth one-chunk glitches, tag every chunk B / I / E / O,
number the runs, flag runs that are too short or whose offset steps have no
unique mode, and roll each run up to one (start, end) segment.

Plan shape (``strategy='window'``): every window uses the same
``partitionBy(keys).orderBy(order)`` spec, so Catalyst plans ONE hash
exchange on the keys and one sort; the per-segment aggregates group by
(keys, match_id), which that hash partitioning already satisfies, so no
further exchange of row-level data happens.  ``strategy='blocked'``
(:func:`tag_chunks_blocked`) gives the same rows without any task holding a
whole timeline, for keys too large for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG_B, TAG_I, TAG_E, TAG_O = "B", "I", "E", "O"


def eq(a: Column, b: Column) -> Column:
    """Equality where null equals nothing (not even null): NaN-like labels."""
    return F.coalesce(a == b, F.lit(False))


def _window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_neighbours(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("video_id",),
                    order: Sequence[str] = ("start",), strategy: str = "window",
                    bucket: Column | None = None) -> DataFrame:
    """``prev_<c>`` / ``next_<c>`` = value of the previous / next row
    (``strategy='blocked'``: dense positions + neighbour context, no per-key window)."""
    if strategy == "blocked":
        from reelforge.operators.sequence import neighbour_window, sequence_index
        k = list(keys)
        cs = [c for c in cols if c in df.columns]
        rest = [c for c in df.columns if c not in k and c not in cs]
        b = bucket if bucket is not None else F.floor(F.col(order[0]) / (5000 * (1 << 14)))
        ctx = neighbour_window(sequence_index(df, k, order, b, out="_pos"), k, "_pos", cs, 1)
        return ctx.select(*k, *rest, *cs, *[F.col(f"{c}_m1").alias(f"prev_{c}") for c in cs],
                          *[F.col(f"{c}_p1").alias(f"next_{c}") for c in cs])
    w = _window(keys, order)
    out = {}
    for c in cols:
        if c in df.columns:
            out[f"prev_{c}"] = F.lag(c).over(w)
            out[f"next_{c}"] = F.lead(c).over(w)
    return df.withColumns(out)


def smooth_labels(df: DataFrame, label: str = "song_id", offset: str = "offset_seconds",
                  offset_mode: str = "half_diff") -> DataFrame:
    """W2 + W3: a chunk whose two neighbours agree with each other but not with
    it takes the neighbours' label; its offset becomes ``(next - prev) / 2``
    (``offset_mode='half_diff'``, what the original computes) or the mean of
    the neighbours (``'mean'``, what its docstring says).  Uses the original
    neighbours only: smoothing does not cascade.  Needs W1 columns."""
    if offset_mode not in ("half_diff", "mean"):
        raise ValueError(f"unknown offset_mode {offset_mode!r}")
    p, n, c = F.col(f"prev_{label}"), F.col(f"next_{label}"), F.col(label)
    return df.withColumns({
        label: F.when(eq(p, n) & ~eq(p, c), p).otherwise(c),
        offset: smoothed_offset(label, offset, offset_mode),
    })


def smoothed_offset(label: str, offset: str, offset_mode: str) -> Column:
    """A chunk's offset after smoothing.  Needs W1 columns."""
    p, n = F.col(f"prev_{label}"), F.col(f"next_{label}")
    po, no = F.col(f"prev_{offset}"), F.col(f"next_{offset}")
    new_off = (no - po) / 2 if offset_mode == "half_diff" else (no + po) / 2
    return F.when(eq(p, n) & ~eq(p, F.col(label)), new_off).otherwise(F.col(offset))


def tag_bieo(df: DataFrame, label: str = "song_id", tag: str = "match_tag") -> DataFrame:
    """B = run start, I = inside, E = run end, O = singleton or null."""
    p, c, n = F.col(f"prev_{label}"), F.col(label), F.col(f"next_{label}")
    return df.withColumn(
        tag,
        F.when(~eq(p, c) & eq(c, n), F.lit(TAG_B))
         .when(eq(p, c) & eq(c, n), F.lit(TAG_I))
         .when(eq(p, c) & ~eq(c, n), F.lit(TAG_E))
         .otherwise(F.lit(TAG_O)))


def offset_step(df: DataFrame, offset: str = "offset_seconds", tag: str = "match_tag",
                out: str = "offset_diff") -> DataFrame:
    """Offset step to the previous chunk on I / E rows, half-even rounded."""
    return df.withColumn(
        out,
        F.when(F.col(tag).isin(TAG_I, TAG_E),
               F.bround(F.col(offset) - F.col(f"prev_{offset}"), 0)))


def segment_ids(df: DataFrame, keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("start",),
                tag: str = "match_tag", out: str = "match_id") -> DataFrame:
    """Running count of B rows; null on O rows."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(F.when(F.col(tag) == TAG_B, 1).otherwise(0)).over(w).cast("long")
    return df.withColumn(out, F.when(F.col(tag).isin(TAG_B, TAG_I, TAG_E), running))


def segment_value_counts(rows: DataFrame, keys: Sequence[str] = ("video_id",), segment: str = "match_id",
                         label: str = "song_id", value: str = "offset_diff") -> DataFrame:
    """The one pass over row-level data that all segment statistics need:
    rows per (segment, label, value) with their time span.  Partial
    aggregation runs map-side, so a long segment never lands in one row."""
    gk = [*keys, segment]
    return (rows.filter(F.col(segment).isNotNull()).groupBy(*gk, label, value)
            .agg(F.count(F.lit(1)).alias("_f"), F.min("start").alias("_s"), F.max("end").alias("_e")))


def segment_stats(counts: DataFrame, keys: Sequence[str] = ("video_id",), segment: str = "match_id",
                  label: str = "song_id", value: str = "offset_diff", min_chunks: int = 3) -> DataFrame:
    """A2 + A3 + A4 from :func:`segment_value_counts`.

    * ``n_chunks`` / ``too_small`` (A3): rows per segment, B row included.
    * ``invalid_mode`` (A4): 1 unless ``value`` has a unique mode, following
      ``statistics.mode`` of Python 3.7 (a tie for the top count has no mode);
      each null is its own value of frequency 1 (NaN equals nothing).
    * ``start`` / ``end`` (A2): min start, max end.
    A segment is a run of one label, so ``label`` is constant inside it.
    """
    gk = [*keys, segment]
    v = F.col(value)
    top = F.max(F.when(v.isNotNull(), F.col("_f"))).over(Window.partitionBy(*gk))
    agg = (counts.withColumn("_m", top).groupBy(*gk)
           .agg(F.min(label).alias(label), F.sum("_f").cast("long").alias("n_chunks"),
                F.min("_s").alias("start"), F.max("_e").alias("end"),
                F.max("_m").alias("_maxf"),
                F.count(F.when(v.isNotNull() & (F.col("_f") == F.col("_m")), 1)).alias("_ntop"),
                F.coalesce(F.sum(F.when(v.isNull(), F.col("_f"))), F.lit(0)).alias("_nnull")))
    unique = (F.when(F.col("_maxf") > 1, F.col("_ntop") == 1)
              .otherwise(F.col("_ntop") + F.col("_nnull") == 1))
    return agg.select(*gk, label, "n_chunks", "start", "end",
                      F.when(F.col("n_chunks") >= min_chunks, 0).otherwise(1).cast("int").alias("too_small"),
                      F.when(unique, 0).otherwise(1).cast("int").alias("invalid_mode"))


def mode_flags(rows: DataFrame, keys: Sequence[str] = ("video_id",), segment: str = "match_id",
               value: str = "offset_diff", label: str = "song_id") -> DataFrame:
    """A4: per segment, ``invalid_mode`` (see :func:`segment_stats`)."""
    st = segment_stats(segment_value_counts(rows, keys, segment, label, value), keys, segment, label, value)
    return st.select(*keys, segment, "invalid_mode")


def segment_sizes(rows: DataFrame, keys: Sequence[str] = ("video_id",), segment: str = "match_id",
                  min_chunks: int = 3, label: str = "song_id", value: str = "offset_diff") -> DataFrame:
    """A3: rows per segment (B row included) and the too-small flag."""
    st = segment_stats(segment_value_counts(rows, keys, segment, label, value), keys, segment, label, value,
                       min_chunks)
    return st.select(*keys, segment, "n_chunks", "too_small")


def flag_segments(rows: DataFrame, keys: Sequence[str] = ("video_id",), segment: str = "match_id",
                  value: str = "offset_diff", min_chunks: int = 3, label: str = "song_id") -> DataFrame:
    """Segment rows with ``too_small`` and ``invalid_mode`` flags."""
    gk = [*keys, segment]
    st = segment_stats(segment_value_counts(rows, keys, segment, label, value), keys, segment, label, value,
                       min_chunks)
    return rows.filter(F.col(segment).isNotNull()).join(st.select(*gk, "too_small", "invalid_mode"), gk)


def rollup_segments(rows: DataFrame, keys: Sequence[str] = ("video_id",), segment: str = "match_id",
                    label: str = "song_id") -> DataFrame:
    """A2: min start, max end, max invalid flag per (segment, label) of flagged rows."""
    return (rows.groupBy(*keys, segment, label)
            .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                 F.max("invalid_mode").cast("int").alias("invalid_mode")))


def tag_chunks(chunks: DataFrame, keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("start",),
               label: str = "song_id", offset: str = "offset_seconds",
               offset_mode: str = "half_diff") -> DataFrame:
    """W1 -> W2/W3 -> W1 -> W4 -> W5 -> W6 on all timelines at once."""
    df = with_neighbours(chunks, [label, offset], keys, order)
    df = smooth_labels(df, label, offset, offset_mode)
    df = df.drop(*[f"{p}_{c}" for p in ("prev", "next") for c in (label, offset)])
    df = with_neighbours(df, [label, offset], keys, order)
    df = tag_bieo(df, label)
    df = offset_step(df, offset)
    return segment_ids(df, keys, order)


def _smooth(pl, cl, nl, po, co, no, offset_mode):
    needs = eq(pl, nl) & ~eq(pl, cl)
    new_off = (no - po) / 2 if offset_mode == "half_diff" else (no + po) / 2
    return F.when(needs, pl).otherwise(cl), F.when(needs, new_off).otherwise(co)


def tag_chunks_blocked(chunks: DataFrame, keys: Sequence[str] = ("video_id",), start: str = "start",
                       label: str = "song_id", offset: str = "offset_seconds", offset_mode: str = "half_diff",
                       span: int = 5000 * (1 << 14), block_rows: int = 1 << 16,
                       dense_position: Column | None = None) -> DataFrame:
    """Skew-safe W1-W6: same rows and values as :func:`tag_chunks`, but no
    step sends all rows of one timeline to one task.

    1. dense positions per timeline (numbered per ``span`` of ``start``), or
       ``dense_position`` when the caller knows one (chunks on a fixed grid
       without gaps, e.g. ``start / chunk_ms``);
    2. the raw values at positions -2..+2 of every row, from windows over
       (timeline, block of positions) with 2 halo rows copied across each
       block edge - enough to smooth the row and both neighbours and to tag it;
    3. segment ids as a running count of B rows on the same (timeline, block)
       partitioning with carried block totals."""
    from reelforge.operators.sequence import neighbour_window, sequence_index
    k = list(keys)
    base = chunks.select(*k, start, "end", label, offset)
    if dense_position is not None:
        idx = base.withColumn("idx", dense_position.cast("long"))
    else:
        idx = sequence_index(base, k, [start], F.floor(F.col(start) / span))
    ctx = neighbour_window(idx, k, "idx", [label, offset], 2, block_rows)
    L = lambda s: F.col(f"{label}{s}")
    O = lambda s: F.col(f"{offset}{s}")
    l_m1, o_m1 = _smooth(L("_m2"), L("_m1"), L(""), O("_m2"), O("_m1"), O(""), offset_mode)
    l_0, o_0 = _smooth(L("_m1"), L(""), L("_p1"), O("_m1"), O(""), O("_p1"), offset_mode)
    l_p1, _ = _smooth(L(""), L("_p1"), L("_p2"), O(""), O("_p1"), O("_p2"), offset_mode)
    tag = (F.when(~eq(l_m1, l_0) & eq(l_0, l_p1), F.lit(TAG_B))
           .when(eq(l_m1, l_0) & eq(l_0, l_p1), F.lit(TAG_I))
           .when(eq(l_m1, l_0) & ~eq(l_0, l_p1), F.lit(TAG_E))
           .otherwise(F.lit(TAG_O)))
    rows = ctx.select(*k, "_blk", "idx", start, "end", l_0.alias(label), o_0.alias(offset), o_m1.alias("_po"),
                      tag.alias("match_tag"))
    rows = rows.withColumn("offset_diff", F.when(F.col("match_tag").isin(TAG_I, TAG_E),
                                                 F.bround(F.col(offset) - F.col("_po"), 0))).drop("_po")
    # running B-count: a window on the same (key, block) partitioning (no new exchange)
    # plus the carried totals of earlier blocks (one row per block)
    isb = F.when(F.col("match_tag") == TAG_B, 1).otherwise(0)
    w = Window.partitionBy(*k, "_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_b1", isb).withColumn("_loc", F.sum("_b1").over(w))
    tot = rows.groupBy(*k, "_blk").agg(F.sum("_b1").alias("_tot"))
    carry = tot.select(*k, "_blk", F.coalesce(F.sum("_tot").over(
        Window.partitionBy(*k).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    rows = rows.join(carry, [*k, "_blk"]).withColumn("_run", (F.col("_c") + F.col("_loc")).cast("long"))
    return (rows.withColumn("match_id", F.when(F.col("match_tag").isin(TAG_B, TAG_I, TAG_E), F.col("_run")))
            .drop("_run", "_b1", "_loc", "_c", "_blk", "idx"))


def segment_timeline(chunks: DataFrame, keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("start",),
                     label: str = "song_id", offset: str = "offset_seconds", min_chunks: int = 3,
                     offset_mode: str = "half_diff", strategy: str = "window", **blocked_args) -> DataFrame:
    """The whole segmentation (W1-W7 + A2), one plan over every timeline.

    Returns one row per kept segment:
    ``keys..., match_id, <label>, start, end, invalid_mode``.

    ``strategy='window'``: row-level data is shuffled exactly once (hash on
    ``keys``, shared by every window); fastest while one timeline fits a task.
    ``strategy='blocked'``: :func:`tag_chunks_blocked`, for timelines too long
    for one task (a hot key).  Either way all segment statistics come from one
    partial aggregation of the tagged rows.
    """
    if strategy == "blocked":
        rows = tag_chunks_blocked(chunks, keys, order[0], label, offset, offset_mode, **blocked_args)
    elif strategy == "window":
        rows = tag_chunks(chunks, keys, order, label, offset, offset_mode)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    st = segment_stats(segment_value_counts(rows, keys, "match_id", label, "offset_diff"),
                       keys, "match_id", label, "offset_diff", min_chunks)
    return (st.filter(F.col("too_small") == 0)
            .select(*keys, "match_id", label, "start", "end", "invalid_mode"))
