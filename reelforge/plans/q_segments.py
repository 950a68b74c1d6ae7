"""Queries for the segmentation family (W1-W8, A2-A4) over the chunk adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.operators import segments as seg
from reelforge.plans.adapters import CHUNKS_SQL, chunks, with_ctes
from reelforge.plans.registry import register

K, O = ["video_id"], ["start"]


def _dense():
    """Chunks lie densely on the 5 s grid: the start gives the position."""
    return F.col("start") / 5000


def _tagged(spark, sf):
    """W1-W6 rows; timelines are cut into blocks of positions."""
    return seg.tag_chunks_blocked(chunks(spark, sf), K, dense_position=_dense())


def _neighbours(spark, sf):
    return seg.with_neighbours(chunks(spark, sf), ["song_id", "offset_seconds"], K, O, "blocked")


# ---- oracle building blocks (DuckDB SQL) -----------------------------------
_N1 = """SELECT *, lag(song_id) OVER w AS p_id, lead(song_id) OVER w AS n_id,
       lag(offset_seconds) OVER w AS p_off, lead(offset_seconds) OVER w AS n_off
FROM chunks WINDOW w AS (PARTITION BY video_id ORDER BY start)"""
_NEEDS = "(coalesce(p_id = n_id, false) AND NOT coalesce(p_id = song_id, false))"
_SM = f"""SELECT video_id, start, "end",
       CASE WHEN {_NEEDS} THEN p_id ELSE song_id END AS song_id,
       CASE WHEN {_NEEDS} THEN (n_off - p_off) / 2 ELSE offset_seconds END AS offset_seconds
FROM n1"""
_N2 = _N1.replace("FROM chunks", "FROM sm")
_TG = """SELECT *, CASE
   WHEN NOT coalesce(p_id = song_id, false) AND coalesce(song_id = n_id, false) THEN 'B'
   WHEN coalesce(p_id = song_id, false) AND coalesce(song_id = n_id, false) THEN 'I'
   WHEN coalesce(p_id = song_id, false) AND NOT coalesce(song_id = n_id, false) THEN 'E'
   ELSE 'O' END AS match_tag
FROM n2"""
_DF = """SELECT *,
   CASE WHEN match_tag IN ('I', 'E') THEN round_even(offset_seconds - p_off, 0) END AS offset_diff,
   CASE WHEN match_tag <> 'O' THEN CAST(sum(CASE WHEN match_tag = 'B' THEN 1 ELSE 0 END)
        OVER (PARTITION BY video_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
   END AS match_id
FROM tg"""
_MODES = """SELECT video_id, match_id, CAST(CASE WHEN count(*) = 1 THEN 0 ELSE 1 END AS INTEGER) AS invalid_mode
FROM (SELECT video_id, match_id, rank() OVER (PARTITION BY video_id, match_id ORDER BY f DESC) AS r
      FROM (SELECT video_id, match_id, offset_diff, count(*) AS f FROM segrows
            WHERE offset_diff IS NOT NULL GROUP BY 1, 2, 3
            UNION ALL
            SELECT video_id, match_id, NULL, 1 FROM segrows WHERE offset_diff IS NULL) v) r
WHERE r = 1 GROUP BY 1, 2"""
_SIZES = """SELECT video_id, match_id, count(*) AS n_chunks,
       CAST(CASE WHEN count(*) >= 3 THEN 0 ELSE 1 END AS INTEGER) AS too_small
FROM segrows GROUP BY 1, 2"""

_BASE = dict(chunks=CHUNKS_SQL, n1=_N1, sm=_SM, n2=_N2, tg=_TG, df=_DF)


def _sql(body: str, upto: str, **extra: str) -> str:
    names = list(_BASE)
    ctes = {n: _BASE[n] for n in names[: names.index(upto) + 1]}
    ctes.update(extra)
    return with_ctes(body, **ctes)


_SEGROWS = "SELECT * FROM df WHERE match_id IS NOT NULL"


# ---- W1 ----------------------------------------------------------------------
@register("w01_prev_next", _sql("""SELECT video_id, start, song_id, offset_seconds,
  p_id AS prev_song_id, n_id AS next_song_id, p_off AS prev_offset_seconds, n_off AS next_offset_seconds
FROM n1""", "n1"))
def w01_prev_next(spark, sf):
    df = _neighbours(spark, sf)
    return df.select("video_id", "start", "song_id", "offset_seconds", "prev_song_id", "next_song_id",
                     "prev_offset_seconds", "next_offset_seconds")


# ---- W2 / W3 -------------------------------------------------------------------
@register("w02_smooth_labels", _sql("SELECT video_id, start, song_id FROM sm", "sm"))
def w02_smooth_labels(spark, sf):
    return seg.smooth_labels(_neighbours(spark, sf)).select("video_id", "start", "song_id")


@register("w03_smooth_offset", _sql(f"""SELECT video_id, start,
  CASE WHEN {_NEEDS} THEN (n_off - p_off) / 2 ELSE offset_seconds END AS offset_half_diff,
  CASE WHEN {_NEEDS} THEN (n_off + p_off) / 2 ELSE offset_seconds END AS offset_mean
FROM n1""", "n1"))
def w03_smooth_offset(spark, sf):
    df = _neighbours(spark, sf)
    both = {mode: seg.smoothed_offset("song_id", "offset_seconds", mode) for mode in ("half_diff", "mean")}
    return df.select("video_id", "start", *[c.alias(f"offset_{mode}") for mode, c in both.items()])


# ---- W4 / W5 / W6 --------------------------------------------------------------
@register("w04_bieo_tags", _sql("SELECT video_id, start, song_id, match_tag FROM tg", "tg"))
def w04_bieo_tags(spark, sf):
    return _tagged(spark, sf).select("video_id", "start", "song_id", "match_tag")


@register("w05_offset_step", _sql("SELECT video_id, start, match_tag, offset_diff FROM df", "df"))
def w05_offset_step(spark, sf):
    return _tagged(spark, sf).select("video_id", "start", "match_tag", "offset_diff")


@register("w06_segment_ids", _sql("SELECT video_id, start, match_tag, match_id FROM df", "df"))
def w06_segment_ids(spark, sf):
    return _tagged(spark, sf).select("video_id", "start", "match_tag", "match_id")


# ---- W7 / A2 / A3 / A4 ---------------------------------------------------------
@register("w07_flag_segments", _sql("""SELECT r.video_id, r.match_id, r.start, s.too_small, m.invalid_mode
FROM segrows r JOIN sizes s USING (video_id, match_id) JOIN modes m USING (video_id, match_id)""", "df",
                                    segrows=_SEGROWS, sizes=_SIZES, modes=_MODES))
def w07_flag_segments(spark, sf):
    rows = _tagged(spark, sf)
    return seg.flag_segments(rows, K).select("video_id", "match_id", "start", "too_small", "invalid_mode")


@register("a02_segment_rollup", _sql("""SELECT r.video_id, r.match_id, r.song_id, min(r.start) AS start,
  max(r."end") AS "end", CAST(max(m.invalid_mode) AS INTEGER) AS invalid_mode
FROM segrows r JOIN modes m USING (video_id, match_id) GROUP BY 1, 2, 3""", "df", segrows=_SEGROWS, modes=_MODES))
def a02_segment_rollup(spark, sf):
    rows = seg.flag_segments(_tagged(spark, sf), K, min_chunks=0)
    return seg.rollup_segments(rows, K)


@register("a03_segment_size", _sql("SELECT * FROM sizes", "df", segrows=_SEGROWS, sizes=_SIZES))
def a03_segment_size(spark, sf):
    return seg.segment_sizes(_tagged(spark, sf), K)


@register("a04_unique_mode", _sql("SELECT * FROM modes", "df", segrows=_SEGROWS, modes=_MODES))
def a04_unique_mode(spark, sf):
    return seg.mode_flags(_tagged(spark, sf), K)


# ---- W8 flagship ---------------------------------------------------------------
W08_SQL = _sql("""SELECT s.video_id, s.match_id, s.song_id, s.start, s."end", m.invalid_mode
FROM (SELECT video_id, match_id, song_id, count(*) AS n, min(start) AS start, max("end") AS "end"
      FROM segrows GROUP BY 1, 2, 3) s
JOIN modes m USING (video_id, match_id)
WHERE s.n >= 3""", "df", segrows=_SEGROWS, modes=_MODES)


@register("w08_segmentation", W08_SQL)
def w08_segmentation(spark, sf):
    """Timelines in blocks of positions: no task holds a whole timeline."""
    return seg.segment_timeline(chunks(spark, sf), K, O, strategy="blocked", dense_position=_dense())


@register("w08_segmentation_blocked", W08_SQL)
def w08_segmentation_blocked(spark, sf):
    """W8 with positions numbered by spans and tiny blocks, so every path is exercised."""
    return seg.segment_timeline(chunks(spark, sf), K, O, strategy="blocked",
                                span=5000 * 16, block_rows=32)
