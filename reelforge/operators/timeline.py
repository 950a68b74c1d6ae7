"""Timeline slicing and short/mid-term pooling.

Chunk generators are ``explode(sequence(...))`` row generators (no join);
pooling windows are explicit window ids exploded per sample, so every
aggregate is a partial (map-side) aggregate keyed by (series, window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6


def fixed_chunks(df: DataFrame, length_ms: str, chunk_ms: int = 5000) -> DataFrame:
    """Cut ``[0, length)`` into ``chunk_ms`` slots; the last chunk is
    short but keeps its nominal end (start + chunk)."""
    n = F.col(length_ms)
    return (df.filter(n > 0)
            .withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"),
                                                      F.lit(chunk_ms).cast("long"))))
            .withColumn("end", F.col("start") + chunk_ms))


def full_chunks(df: DataFrame, length_s: str, chunk_s: str | Column, start_ms: str | None = None) -> DataFrame:
    """Offsets ``0, c, 2c, ...`` keeping only chunks that fit whole
    (the tail is dropped); ``chunk <= 0`` gives no chunks instead of looping
    forever (N22).  ``starting_point`` = start / 1000 + offset."""
    L = F.col(length_s)
    c = F.col(chunk_s) if isinstance(chunk_s, str) else chunk_s
    n = F.floor(L / c)
    out = (df.filter((c > 0) & (n >= 1))
           .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
           .withColumn("chunk_index", F.col("_i") * c).drop("_i"))
    if start_ms:
        out = out.withColumn("starting_point", F.col(start_ms) / 1000 + F.col("chunk_index"))
    return out


def batches(df: DataFrame, order: Sequence[str], size: int = 200) -> DataFrame:
    """Fixed-size batches in listing order: ``batch = (position - 1) div size``.
    Positions come from the dense numbering of range buckets (no one-partition window)."""
    from reelforge.operators.training import assign_ids
    return assign_ids(df, order, start=1, out="_pos").withColumn(
        "batch", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


def mid_term_pool(frames: DataFrame, keys: Sequence[str], ts_ms: str, features: Sequence[str],
                  win_ms: int = 2000, step_ms: int = 1000) -> DataFrame:
    """Mid-term windows of ``win_ms`` every ``step_ms`` (window w covers
    [w*step, w*step + win)); per window mean and population std of each
    short-term feature, then the mean of those over all windows."""
    k = list(keys)
    per = win_ms // step_ms
    t = F.col(ts_ms)
    wids = F.filter(F.transform(F.sequence(F.lit(0), F.lit(per - 1)),
                                lambda j: (F.floor(t / step_ms) - j).cast("long")), lambda w: w >= 0)
    # keep only windows that really contain the sample (win not a multiple of step)
    ex = frames.withColumn("win", F.explode(wids)).filter(t < F.col("win") * step_ms + win_ms)
    long = ex.select(*k, "win", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                             F.col(f).cast("double").alias("v"))
                                                    for f in features])).alias("fv")).select(*k, "win", "fv.*")
    mid = long.groupBy(*k, "win", "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return (mid.groupBy(*k, "feature")
            .agg(r6(F.avg("mean")).alias("mean_of_means"), r6(F.avg("std")).alias("mean_of_stds"),
                 F.count(F.lit(1)).alias("n_windows")))


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
           strategy: str = "window", bucket: Column | None = None) -> DataFrame:
    """``delta <c>`` = value minus previous short frame's, 0 on the first
    (``strategy='blocked'`` finds the previous frame without a per-key window)."""
    from reelforge.operators.frames import _previous
    d = _previous(df, keys, order, cols, strategy, bucket)
    d = d.withColumns({f"delta {c}": F.coalesce(F.col(c) - F.col(f"prev_{c}"), F.lit(0.0)) for c in cols})
    return d.drop(*[f"prev_{c}" for c in cols])


def short_frame_features(samples: DataFrame, keys: Sequence[str], frame: str, pos: str, x: str,
                         frame_len: int, n_blocks: int = 10, eps: float = 1e-8) -> DataFrame:
    """Per short frame of samples: zero-crossing rate, energy and energy
    entropy over ``n_blocks`` equal consecutive sub-blocks (the published
    definitions; ``frame_len`` = samples per full frame)."""
    k = [*keys, frame]
    sub_len = frame_len // n_blocks
    w = Window.partitionBy(*k).orderBy(pos)
    sgn = F.signum(F.col(x))
    s = samples.select(*k, pos, x, F.abs(sgn - F.lag(sgn).over(w)).alias("_dz"),
                       F.floor(F.col(pos) / sub_len).alias("_blk"))
    fr = s.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.sum("_dz").alias("_z"),
                           F.sum(F.col(x) * F.col(x)).alias("_e"))
    blocks = (s.filter(F.col("_blk") < n_blocks).groupBy(*k, "_blk").agg(F.sum(F.col(x) * F.col(x)).alias("_be"))
              .join(fr.select(*k, "_e"), k)
              .withColumn("_p", F.col("_be") / (F.col("_e") + eps))
              .groupBy(*k).agg(F.sum(-F.col("_p") * F.log2(F.col("_p") + eps)).alias("energy_entropy")))
    return (fr.join(blocks, k, "left")
            .select(*k, r6(F.coalesce(F.col("_z"), F.lit(0.0)) / 2 / (F.col("_n") - 1)).alias("zcr"),
                    r6(F.col("_e") / F.col("_n")).alias("energy"), r6("energy_entropy").alias("energy_entropy")))
