"""Object detections: tracking, smoothing and statistics.

Detections are rows ``(video_id, frame, det, label, box, conf)`` with
``box = struct(l, b, r, t)`` in [0, 1].  Sliding windows of ``w`` frames
become an equi-join key (the window start) instead of nested loops: each
detection is exploded to the (at most ``w - 1``) windows in which it is a
follower and joined to the anchors of that window on (video, start, label).
Join groups are bounded by the detector's detections per frame times ``w``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.functions.scalar import (DETECTOR_SIDE_PX, ltrb_to_xywh, overlap_ratio, r6, raw_as_xywh,
                                        rect_area, super_category)


def _as_rect(box, box_format: str):
    if box_format == "raw":
        return raw_as_xywh(box)
    if box_format == "ltrb":
        return ltrb_to_xywh(box)
    raise ValueError(f"unknown box_format {box_format!r}")


def window_starts(frames: DataFrame, keys: Sequence[str], frame: str, n_frames: str, w: int) -> DataFrame:
    """Every frame with the start of each group of ``w`` adjacent frames
    that contains it; groups start at 0..n-w (a video with fewer than ``w``
    frames has none)."""
    f = F.col(frame)
    lo = F.greatest(f - (w - 1), F.lit(0))
    hi = F.least(f, F.col(n_frames) - w)
    return (frames.filter(hi >= lo)
            .withColumn("group_start", F.explode(F.sequence(lo.cast("long"), hi.cast("long")))))


def track_objects(dets: DataFrame, keys: Sequence[str] = ("video_id",), w: int = 3,
                  overlap_threshold: float = 0.8, box_format: str = "raw") -> DataFrame:
    """For every group start s, each detection of frame s (the anchor)
    collects the detections of frames s+1..s+w-1 with the same label whose
    box overlap with the anchor's lies in [threshold, 1].  Returns one row per
    (anchor, match) plus the anchor itself (``offset = 0``)."""
    k = list(keys)
    nf = dets.groupBy(*k).agg((F.max("frame") + 1).alias("_n"))
    d = dets.join(nf, k)
    anchors = d.filter(F.col("frame") <= F.col("_n") - w).select(
        *k, F.col("frame").alias("group_start"), F.col("det").alias("a_det"), "label",
        F.col("box").alias("a_box"), F.col("conf").alias("a_conf"))
    f = F.col("frame")
    lo = F.greatest(f - (w - 1), F.lit(0))
    hi = F.least(f - 1, F.col("_n") - w)
    followers = (d.filter(hi >= lo)
                 .select(*k, "frame", "det", "label", "box", "conf",
                         F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("group_start")))
    ov = overlap_ratio(_as_rect(F.col("a_box"), box_format), _as_rect(F.col("box"), box_format))
    matches = (anchors.join(followers, [*k, "group_start", "label"])
               .filter((ov >= overlap_threshold) & (ov <= 1))
               .select(*k, "group_start", "a_det", "label", "frame", "det", "box", "conf"))
    self_rows = anchors.select(*k, "group_start", "a_det", "label", F.col("group_start").alias("frame"),
                               F.col("a_det").alias("det"), F.col("a_box").alias("box"), F.col("a_conf").alias("conf"))
    return self_rows.unionByName(matches)


def smooth_objects(tracks: DataFrame, keys: Sequence[str] = ("video_id",), w: int = 3,
                   mean_confidence_threshold: float = 0.5, box_format: str = "raw") -> DataFrame:
    """A10: keep tracked anchors seen in at least ``w`` rows (matches are
    counted, not distinct frames, N21) whose mean confidence is at least the
    threshold; report the smallest box (first smallest in frame, det order)."""
    k = list(keys)
    area = rect_area(_as_rect(F.col("box"), box_format))
    g = tracks.groupBy(*k, "group_start", "a_det", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("conf").alias("conf"),
        F.min_by("box", F.struct(area, F.col("frame"), F.col("det"))).alias("box"))
    return (g.filter((F.col("n_rows") >= w) & (F.col("conf") >= mean_confidence_threshold))
            .select(*k, "group_start", "a_det", "label", "conf", "box"))


def smooth_object_confidence(dets: DataFrame, keys: Sequence[str] = ("video_id",), w: int = 3,
                             overlap_threshold: float = 0.8, mean_confidence_threshold: float = 0.5,
                             box_format: str = "raw") -> DataFrame:
    """W15 = W14 -> J14 -> A10."""
    return smooth_objects(track_objects(dets, keys, w, overlap_threshold, box_format), keys, w,
                          mean_confidence_threshold, box_format)


def _area_px(box):
    """Box area in detector pixels from truncated ints (N24); integer, so
    sums are exact and the ratio is taken once at the end."""
    side = DETECTOR_SIDE_PX
    w = ((box["r"] - box["l"]) * side).cast("long")
    h = ((box["t"] - box["b"]) * side).cast("long")
    return w * h


_FRAME_PX = float(DETECTOR_SIDE_PX * DETECTOR_SIDE_PX)


def object_features(smoothed: DataFrame, n_groups: DataFrame, keys: Sequence[str] = ("video_id",),
                    level: str = "super") -> DataFrame:
    """Per video and (super) category: objects per smoothed frame, mean
    confidence (0 when absent) and mean area ratio per frame (N24 truncation).
    ``n_groups``: (keys, n_frames) = number of smoothed frames per video.
    Dense over all categories by exploding the category ids per video."""
    k = list(keys)
    cat = super_category("label") if level == "super" else F.col("label").cast("int")
    ncat = 12 if level == "super" else 80
    s = smoothed.select(*k, cat.alias("category"), "conf", _area_px(F.col("box")).alias("ar"))
    agg = s.groupBy(*k, "category").agg(F.count(F.lit(1)).alias("_c"), F.sum("conf").alias("_sc"),
                                        F.sum("ar").alias("_sa"))
    grid = n_groups.select(*k, "n_frames", F.explode(F.sequence(F.lit(1), F.lit(ncat))).alias("category"))
    j = grid.join(agg, [*k, "category"], "left")
    return j.select(*k, "category",
                    r6(F.coalesce(F.col("_c"), F.lit(0)) / F.col("n_frames")).alias("labels_freq"),
                    r6(F.coalesce(F.col("_sc") / F.col("_c"), F.lit(0.0))).alias("labels_avg_confidence"),
                    r6(F.coalesce(F.col("_sa"), F.lit(0)) / _FRAME_PX / F.col("n_frames")).alias("labels_area_ratio"))


def object_features_per_frame(smoothed: DataFrame, frames: DataFrame, keys: Sequence[str] = ("video_id",),
                              level: str = "super") -> DataFrame:
    """Per smoothed frame and category: count, mean confidence (0 when
    absent) and summed area ratio; ``frames`` lists (keys, group_start)."""
    k = list(keys)
    cat = super_category("label") if level == "super" else F.col("label").cast("int")
    ncat = 12 if level == "super" else 80
    s = smoothed.select(*k, "group_start", cat.alias("category"), "conf", _area_px(F.col("box")).alias("ar"))
    agg = s.groupBy(*k, "group_start", "category").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("conf").alias("_sc"), F.sum("ar").alias("_sa"))
    grid = frames.select(*k, "group_start", F.explode(F.sequence(F.lit(1), F.lit(ncat))).alias("category"))
    j = grid.join(agg, [*k, "group_start", "category"], "left")
    return j.select(*k, "group_start", "category", F.coalesce("_c", F.lit(0)).cast("long").alias("freq"),
                    r6(F.coalesce(F.col("_sc") / F.col("_c"), F.lit(0.0))).alias("avg_confidence"),
                    r6(F.coalesce(F.col("_sa"), F.lit(0)) / _FRAME_PX).alias("area_ratio"))


def remove_overlaps(rects: DataFrame, keys: Sequence[str], idx: str = "idx", rect: str = "rect",
                    threshold: float = 0.3) -> DataFrame:
    """Within one frame drop rectangle i when a later rectangle j > i
    overlaps it by more than ``threshold`` (deterministic form of N20).  The
    self-join stays inside one frame, whose size the detector bounds."""
    k = list(keys)
    a = rects.select(*k, F.col(idx).alias("_i"), F.col(rect).alias("_ra"))
    b = rects.select(*k, F.col(idx).alias("_j"), F.col(rect).alias("_rb"))
    hit = (a.join(b, k).filter((F.col("_j") > F.col("_i")) & (overlap_ratio("_ra", "_rb") > threshold))
           .select(*k, F.col("_i").alias(idx)).distinct())
    return rects.join(hit, [*k, idx], "left_anti")
