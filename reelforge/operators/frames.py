"""Per-frame and per-video statistics.

Frames are rows ``(video_id, frame_idx, ts_ms, ...)``; per-pixel or
per-vector data are rows keyed by frame.  Every operator is a grouped
aggregate or a window keyed by video, so videos are processed in parallel
and only the rows of one key meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.scalar import angle_diff, r6


def column_stats(long: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """A5: per group (e.g. video x feature): mean, population std,
    std / (median + 0.0001) and the mean of the top 10 % values
    (``k = floor(n / 10)``, all rows when ``k = 0``, as the original).

    The exact median and the top k come from the ranks of the distinct values
    (:func:`~reelforge.operators.sequence.ranked_values`), each weighted by
    the copies that fall into the wanted ranks."""
    from reelforge.operators.sequence import ranked_values
    g = list(group)
    n, v, c, before = F.col("_n"), F.col(value), F.col("_c"), F.col("_before")
    k = F.floor(n / 10)
    k = F.when(k == 0, n).otherwise(k)

    def copies(lo, hi):
        """Copies of the value among the ranks lo .. hi (1-based)."""
        return F.greatest(F.lit(0), F.least(before + c, hi) - F.greatest(before + 1, lo) + 1)

    mid = copies(F.floor((n + 1) / 2), F.ceil((n + 1) / 2))
    top = copies(n - k + 1, n)
    agg = ranked_values(long, g, value).groupBy(*g, "mean").agg(
        F.sqrt(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum(c)).alias("std"),
        (F.sum(v * mid) / F.sum(mid)).alias("median"), (F.sum(v * top) / F.sum(top)).alias("mean_top10"))
    return agg.select(*g, r6("mean").alias("mean"), r6("std").alias("std"),
                      r6(F.col("std") / (F.col("median") + 0.0001)).alias("stdmean"),
                      r6("mean_top10").alias("mean_top10"))


def histogram(df: DataFrame, group: Sequence[str], value: str, lo: float, width: float, nbins: int) -> DataFrame:
    """Normalised fixed-edge histogram, NumPy rules: bins
    ``[lo + i*width, lo + (i+1)*width)``, the last bin closed, values outside
    ignored.  Dense: every group gets all ``nbins`` bins (missing = 0), built
    by exploding the bin ids per group, not by a cross join."""
    g = list(group)
    v = F.col(value)
    hi = lo + width * nbins
    b = F.least(F.floor((v - lo) / width), F.lit(nbins - 1)).cast("int")
    counted = (df.filter((v >= lo) & (v <= hi)).groupBy(*g, b.alias("bin"))
               .agg(F.count(F.lit(1)).alias("count")))
    totals = counted.groupBy(*g).agg(F.sum("count").alias("_t"))
    grid = totals.select(*g, "_t", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    out = grid.join(counted, [*g, "bin"], "left").fillna(0, subset=["count"])
    return out.select(*g, "bin", F.col("count").cast("long").alias("count"),
                      r6(F.col("count") / F.col("_t")).alias("share"))


def faces_per_frame(frames: DataFrame, faces: DataFrame, keys: Sequence[str], frame_area: float) -> DataFrame:
    """Number of faces and mean face area ratio per frame, 0 if none."""
    k = list(keys)
    f = faces.groupBy(*k).agg(F.count(F.lit(1)).alias("faces_num"),
                              F.avg(F.col("w") * F.col("h") / frame_area).alias("_r"))
    out = frames.select(*k).join(f, k, "left")
    return out.select(*k, F.coalesce("faces_num", F.lit(0)).cast("double").alias("faces_num"),
                      r6(F.coalesce("_r", F.lit(0.0))).alias("faces_ratio"))


def flow_stats(vectors: DataFrame, keys: Sequence[str], diag: float) -> DataFrame:
    """Optical-flow statistics per frame from its vectors (dx, dy):
    mean / std of magnitude / diagonal, angular mean from the truncated mean
    dx, dy, angular std around it, tilt-pan confidence (N18)."""
    k = list(keys)
    dx, dy = F.col("dx"), F.col("dy")
    deg = F.degrees(F.atan2(dy, dx))
    ang = F.when(dy < 0, F.abs(deg)).otherwise(360.0 - deg)
    w = Window.partitionBy(*k)
    # The original truncates the mean dx, dy to int before atan2.  Decimal sums
    # are exact, so a mean that is an integer does not depend on the order.
    n = F.count(F.lit(1)).over(w)

    def total(c):
        return F.sum(c.cast("decimal(30,12)")).over(w)

    def trunc_mean(c):
        return F.call_function("div", total(c), n.cast("decimal(20,0)")).cast("long")  # towards zero
    tdx, tdy = trunc_mean(dx), trunc_mean(dy)
    neg = total(dy) < 0
    mdeg = F.degrees(F.atan2(tdy.cast("double"), tdx.cast("double")))
    mu = F.when(neg, -mdeg).otherwise(360.0 - mdeg)
    v = vectors.select(*k, ang.alias("angle"), (F.sqrt(dx * dx + dy * dy) / diag).alias("mag"), mu.alias("mu"))
    agg = v.groupBy(*k).agg(
        F.avg("mag").alias("mag_mu"), F.stddev_pop("mag").alias("mag_std"), F.max("mu").alias("mu"),
        F.sqrt(F.avg(F.pow(angle_diff(F.col("angle"), F.col("mu")), 2))).alias("angle_std"))
    return agg.select(*k, r6("mag_mu").alias("mag_mu"), r6("mag_std").alias("mag_std"),
                      r6("mu").alias("angle_mu"), r6("angle_std").alias("angle_std"),
                      r6(F.col("mag_mu") / F.sqrt(F.col("angle_std") + 1e-8)).alias("tilt_pan_confidence"))


def colour_ratios(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per pixel the RGB max-vs-mean ratio (clipped to [1, 199]) and the
    value / saturation normalised by their frame maximum + 1."""
    k = list(keys)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    mean = (r + g + b) / 3.0
    ratio = 100.0 * (F.greatest(r, g, b) - mean) / (1.0 + mean)
    w = Window.partitionBy(*k)
    return pixels.select(*k, F.least(F.greatest(ratio, F.lit(1.0)), F.lit(199.0)).alias("rgb_ratio"),
                         (255.0 * F.col("v") / F.max(F.col("v") + 1.0).over(w)).alias("v_norm"),
                         (255.0 * F.col("s") / F.max(F.col("s") + 1.0).over(w)).alias("s_norm"))


def _previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
              strategy: str = "window", bucket: Column | None = None) -> DataFrame:
    """``prev_<c>`` = value of the previous row of the same key: a ``lag``
    window, or (``strategy='blocked'``, for hot keys) dense positions plus a
    neighbour context grouped by (key, position)."""
    k = list(keys)
    if strategy == "window":
        w = Window.partitionBy(*k).orderBy(*order)
        return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})
    if strategy != "blocked" or bucket is None:
        raise ValueError("strategy must be 'window', or 'blocked' with a bucket column")
    from reelforge.operators.sequence import neighbour_window, sequence_index
    rest = [c for c in df.columns if c not in k and c not in cols]
    idx = sequence_index(df, k, order, bucket, out="_pos")
    ctx = neighbour_window(idx, k, "_pos", list(cols), 1)
    return ctx.select(*k, *rest, *cols, *[F.col(f"{c}_m1").alias(f"prev_{c}") for c in cols])


def vector_frame_diff(df: DataFrame, keys: Sequence[str], order: Sequence[str], vec: str,
                      strategy: str = "window", bucket: Column | None = None) -> DataFrame:
    """Mean absolute difference of a vector with the previous frame's; 0 first."""
    df = _previous(df, keys, order, [vec], strategy, bucket)
    prev = F.col(f"prev_{vec}")
    d = F.aggregate(F.zip_with(F.col(vec), prev, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn("frame_diff", F.when(prev.isNull(), F.lit(0.0))
                         .otherwise(r6(d / F.size(F.col(vec))))).drop(f"prev_{vec}")


def grey_change(pixels: DataFrame, keys: Sequence[str], frame: str, pixel: str, grey: str,
                strict: bool = True) -> DataFrame:
    """Share of changed pixels between consecutive frames.  The
    difference wraps like uint8 (``pmod(prev - cur, 256)``); < 50 -> 0,
    > 50 -> 1 and exactly 50 stays 50 as in the original (``strict=False``
    maps 50 to 0).  First frame: no row (there is no previous frame)."""
    prev = F.lag(grey).over(Window.partitionBy(*keys, pixel).orderBy(frame))
    d = F.pmod(prev - F.col(grey), F.lit(256))
    t = F.when(d < 50, 0).when(d > 50, 1).otherwise(50 if strict else 0)
    per = pixels.select(*keys, frame, prev.isNotNull().alias("_has"), t.alias("_t"))
    return (per.filter("_has").groupBy(*keys, frame)
            .agg(r6(F.sum("_t") / F.count(F.lit(1))).alias("gray_diff")))


def shot_votes(frames: DataFrame, mag: str = "mag_mu", gray: str = "gray_diff", fdiff: str = "f_diff") -> Column:
    """W11 vote: at least 2 of (motion > 0.08, grey change > 0.65, histogram difference > 0.02)."""
    c = (F.when(F.col(mag) > 0.08, 1).otherwise(0) + F.when(F.col(gray) > 0.65, 1).otherwise(0)
         + F.when(F.col(fdiff) > 0.02, 1).otherwise(0))
    return c >= 2


def shot_durations(frames: DataFrame, keys: Sequence[str], order: str, change: str,
                   step_s: float = 0.2, strategy: str = "window", bucket: Column | None = None) -> DataFrame:
    """Shot id = number of accepted changes in *preceding* frames (the
    trigger frame closes the old shot, N17); duration = frames in the shot x step.
    ``strategy='blocked'`` counts with dense positions and a blocked running sum."""
    k = list(keys)
    if strategy == "blocked":
        from reelforge.operators.sequence import blocked_running_sum, sequence_index
        if bucket is None:
            raise ValueError("the blocked strategy needs a bucket column")
        idx = sequence_index(frames, k, [order], bucket, out="_pos")
        s = blocked_running_sum(idx, k, "_pos", F.col(change).cast("int"), "_run")
        s = s.withColumn("shot_id", (F.col("_run") - F.col(change).cast("int")).cast("long")).drop("_run", "_pos")
        sizes = s.groupBy(*k, "shot_id").agg(F.count(F.lit(1)).alias("_n"))
        return s.join(sizes, [*k, "shot_id"]).withColumn("shot_duration", r6(F.col("_n") * step_s)).drop("_n")
    w = Window.partitionBy(*k).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shot = F.coalesce(F.sum(F.col(change).cast("int")).over(w), F.lit(0))
    s = frames.withColumn("shot_id", shot.cast("long"))
    return s.withColumn("shot_duration", r6(F.count(F.lit(1)).over(Window.partitionBy(*keys, "shot_id"))
                                                 * step_s))


def downsample(frames: DataFrame, keys: Sequence[str], ts_ms: str, step_ms: int = 200) -> DataFrame:
    """Keep the first frame of every ``step_ms`` slot (fps >= 1000/step_ms)."""
    slot = F.floor(F.col(ts_ms) / step_ms)
    rest = [c for c in frames.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(ts_ms, *[c for c in rest if c != ts_ms]))
    return frames.groupBy(*keys, slot.alias("_slot")).agg(first.alias("_f")).select(*keys, "_f.*").select(*frames.columns)


def frame_counter(frames: DataFrame, keys: Sequence[str], ts: str, strategy: str = "window",
                  bucket: Column | None = None) -> DataFrame:
    """Processed-frame counter (1-based) per video (``strategy='blocked'``:
    bucketed dense numbering, for hot videos)."""
    if strategy == "blocked":
        from reelforge.operators.sequence import sequence_index
        if bucket is None:
            raise ValueError("the blocked strategy needs a bucket column")
        return sequence_index(frames, keys, [ts], bucket, out="_p").withColumn(
            "count_process", F.col("_p") + 1).drop("_p")
    return frames.withColumn("count_process",
                             F.row_number().over(Window.partitionBy(*keys).orderBy(ts)).cast("long"))
