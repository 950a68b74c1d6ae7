"""Queries for frame statistics, shots and objects."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6

from reelforge.functions import scalar as X
from reelforge.operators import frames as FR
from reelforge.operators import objects as OB
from reelforge.operators.chains import accept_with_gap_blocks
from reelforge.plans.adapters import EVENTS_K_SQL, RECTS_SQL, events_k, rects, with_ctes
from reelforge.operators.sequence import sequence_index
from reelforge.plans.registry import register
from reelforge.session import read_table

FRAME_W, FRAME_H = 500, 280
DIAG = math.sqrt(FRAME_W ** 2 + FRAME_H ** 2)


def _seq(spark, sf):
    """events_k plus r = 0-based position in the user's sequence, numbered per
    (user, hour) with carried counts, so no task holds a whole user."""
    e = events_k(spark, sf).withColumnRenamed("user_id", "video_id")
    return sequence_index(e, ["video_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), out="r")


POS_BUCKET = 1 << 12  # positions per bucket in the skew-safe sequence plans


SEQ_SQL = """SELECT user_id AS video_id, event_id, ts, event_type, value, k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events_k"""


def _q(body, **extra):
    return with_ctes(body, events_k=EVENTS_K_SQL, seq=SEQ_SQL, **extra)


def _frame_values(spark, sf):
    """(video_id, feature, value): three features per frame."""
    e = events_k(spark, sf).withColumnRenamed("user_id", "video_id")
    feats = F.explode(F.array(
        F.struct(F.lit("value").alias("feature"), F.sqrt("value").alias("value")),
        F.struct(F.lit("pixel").alias("feature"), F.pmod(F.floor("value"), F.lit(256)).cast("double").alias("value")),
        F.struct(F.lit("k").alias("feature"), F.col("k").cast("double").alias("value"))))
    return e.select("video_id", feats.alias("f")).select("video_id", "f.feature", "f.value")


# ---- A5 column statistics ----------------------------------------------------------------
_A5_SQL = """SELECT {g}, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean, floor(stddev_pop(value) * 1e6 + 0.5) / 1e6 AS std,
  floor(stddev_pop(value) / (quantile_cont(value, 0.5) + 0.0001) * 1e6 + 0.5) / 1e6 AS stdmean,
  floor(avg(value) FILTER (WHERE rd <= CASE WHEN n // 10 = 0 THEN n ELSE n // 10 END) * 1e6 + 0.5) / 1e6 AS mean_top10
FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY value DESC) AS rd,
             count(*) OVER (PARTITION BY {g}) AS n FROM long) GROUP BY {g}"""


@register("a05_column_stats_frames", _q(_A5_SQL.format(g="video_id, feature"), long="""
SELECT video_id, 'value' AS feature, sqrt(value) AS value FROM seq
UNION ALL SELECT video_id, 'pixel', CAST(CAST(floor(value) AS BIGINT) % 256 AS DOUBLE) FROM seq
UNION ALL SELECT video_id, 'k', CAST(k AS DOUBLE) FROM seq"""))
def a05_column_stats_frames(spark, sf):
    return FR.column_stats(_frame_values(spark, sf), ["video_id", "feature"])


@register("a05_column_stats_frames_range", with_ctes(_A5_SQL.format(g="feature"), events_k=EVENTS_K_SQL, long="""
SELECT 'value' AS feature, sqrt(value) AS value FROM events_k
UNION ALL SELECT 'pixel', CAST(CAST(floor(value) AS BIGINT) % 256 AS DOUBLE) FROM events_k
UNION ALL SELECT 'k', CAST(k AS DOUBLE) FROM events_k"""))
def a05_column_stats_frames_range(spark, sf):
    """A5 of a feature over all videos: each group is a third of all values."""
    return FR.column_stats(_frame_values(spark, sf).drop("video_id"), ["feature"])


@register("a05_column_stats_embeddings", with_ctes(_A5_SQL.format(g="label, dim"), long="""
SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings"""))
def a05_column_stats_embeddings(spark, sf):
    e = read_table(spark, sf, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))
    return FR.column_stats(long, ["label", "dim"])


# ---- A6 / A7 histograms --------------------------------------------------------------------
def _hist_sql(src: str, g: str, v: str, lo: float, width: float, nbins: int) -> str:
    hi = lo + width * nbins
    return f"""SELECT grid.{g}, CAST(grid.bin AS INTEGER) AS bin, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count,
  floor((coalesce(c.cnt, 0) / grid.t) * 1e6 + 0.5) / 1e6 AS share
FROM (SELECT {g}, t, unnest(range({nbins})) AS bin FROM
      (SELECT {g}, count(*) AS t FROM {src} WHERE {v} >= {lo} AND {v} <= {hi} GROUP BY 1)) grid
LEFT JOIN (SELECT {g}, CAST(least(floor(({v} - ({lo})) / {width}), {nbins - 1}) AS INTEGER) AS bin, count(*) AS cnt
           FROM {src} WHERE {v} >= {lo} AND {v} <= {hi} GROUP BY 1, 2) c
ON c.{g} = grid.{g} AND c.bin = grid.bin"""


@register("a06_rgb_histogram", _q(_hist_sql("px", "video_id", "pixel", -1, 32, 8),
                                  px="SELECT video_id, CAST(floor(value) AS BIGINT) % 256 AS pixel FROM seq"))
def a06_rgb_histogram(spark, sf):
    px = _seq(spark, sf).select("video_id", F.pmod(F.floor("value"), F.lit(256)).alias("pixel"))
    return FR.histogram(px, ["video_id"], "pixel", -1, 32, 8)


@register("a07_hue_histogram", _q(_hist_sql("px", "video_id", "hue", 0, 1, 179),
                                  px="SELECT video_id, CAST(floor(value) AS BIGINT) % 181 AS hue FROM seq"))
def a07_hue_histogram(spark, sf):
    px = _seq(spark, sf).select("video_id", F.pmod(F.floor("value"), F.lit(181)).alias("hue"))
    return FR.histogram(px, ["video_id"], "hue", 0, 1, 179)


@register("a07_saturation_histogram", _q(_hist_sql("px", "video_id", "sat", 0, 1, 255),
                                         px="SELECT video_id, (k * 7) % 256 AS sat FROM seq"))
def a07_saturation_histogram(spark, sf):
    """A7 with 255 unit bins (saturation / value): 255 falls in the last, closed bin."""
    px = _seq(spark, sf).select("video_id", F.pmod(F.col("k") * 7, F.lit(256)).alias("sat"))
    return FR.histogram(px, ["video_id"], "sat", 0, 1, 255)


# ---- A11 faces, A12 flow, A13 colour -------------------------------------------------------
@register("a11_faces_per_frame", _q(f"""
SELECT f.video_id, f.frame, CAST(coalesce(c.n, 0) AS DOUBLE) AS faces_num, floor((coalesce(c.r, 0.0)) * 1e6 + 0.5) / 1e6 AS faces_ratio
FROM (SELECT DISTINCT video_id, r // 4 AS frame FROM seq) f
LEFT JOIN (SELECT video_id, r // 4 AS frame, count(*) AS n,
                  avg((10 + k % 40) * (10 + CAST(floor(value) AS BIGINT) % 30) / {float(FRAME_W * FRAME_H)}) AS r
           FROM seq WHERE k % 3 = 0 GROUP BY 1, 2) c USING (video_id, frame)"""))
def a11_faces_per_frame(spark, sf):
    s = _seq(spark, sf).withColumn("frame", F.floor(F.col("r") / 4))
    faces = s.filter(F.col("k") % 3 == 0).select("video_id", "frame", (10 + F.col("k") % 40).alias("w"),
                                                 (10 + F.pmod(F.floor("value"), F.lit(30))).alias("h"))
    return FR.faces_per_frame(s.select("video_id", "frame").distinct(), faces, ["video_id", "frame"],
                              float(FRAME_W * FRAME_H))


# truncated mean, as the original: exact sums, then towards zero
_TM = "CAST(trunc(sum(CAST({c} AS DECIMAL(30,12))) OVER w / count(*) OVER w) AS BIGINT)"


@register("a12_flow_stats", _q(f"""
SELECT video_id, frame, floor((avg(mag)) * 1e6 + 0.5) / 1e6 AS mag_mu, floor((stddev_pop(mag)) * 1e6 + 0.5) / 1e6 AS mag_std, floor((max(mu)) * 1e6 + 0.5) / 1e6 AS angle_mu,
  floor((sqrt(avg(pow(CASE WHEN abs(mu - angle) > 180 THEN abs(mu - angle) - 360 ELSE abs(mu - angle) END, 2)))) * 1e6 + 0.5) / 1e6
    AS angle_std,
  floor((avg(mag) / sqrt(sqrt(avg(pow(CASE WHEN abs(mu - angle) > 180 THEN abs(mu - angle) - 360
                                          ELSE abs(mu - angle) END, 2))) + 1e-8)) * 1e6 + 0.5) / 1e6 AS tilt_pan_confidence
FROM (SELECT *, CASE WHEN dy < 0 THEN abs(degrees(atan2(dy, dx))) ELSE 360.0 - degrees(atan2(dy, dx)) END AS angle,
        sqrt(dx * dx + dy * dy) / {DIAG!r} AS mag,
        CASE WHEN sum(CAST(dy AS DECIMAL(30,12))) OVER w < 0
             THEN -degrees(atan2({_TM.format(c='dy')}, {_TM.format(c='dx')}))
             ELSE 360.0 - degrees(atan2({_TM.format(c='dy')}, {_TM.format(c='dx')}))
        END AS mu
      FROM (SELECT video_id, r // 4 AS frame, CAST(k - 50 AS DOUBLE) AS dx, value - 50.0 AS dy FROM seq)
      WINDOW w AS (PARTITION BY video_id, frame))
GROUP BY 1, 2"""))
def a12_flow_stats(spark, sf):
    s = _seq(spark, sf)
    v = s.select("video_id", F.floor(F.col("r") / 4).alias("frame"), (F.col("k") - 50).cast("double").alias("dx"),
                 (F.col("value") - 50.0).alias("dy"))
    return FR.flow_stats(v, ["video_id", "frame"], DIAG)


def _pixels(spark, sf):
    s = _seq(spark, sf)
    return s.select("video_id", F.floor(F.col("r") / 4).alias("frame"),
                    F.pmod(F.floor("value"), F.lit(256)).cast("double").alias("r"),
                    F.pmod(F.col("k") * 3, F.lit(256)).cast("double").alias("g"),
                    F.pmod(F.col("event_id"), F.lit(256)).cast("double").alias("b"),
                    F.pmod(F.col("k") * 7, F.lit(256)).cast("double").alias("s"),
                    F.pmod(F.floor(F.col("value") * 3), F.lit(256)).cast("double").alias("v"))


_PIX_SQL = """SELECT video_id, r // 4 AS frame, CAST(CAST(floor(value) AS BIGINT) % 256 AS DOUBLE) AS r,
  CAST((k * 3) % 256 AS DOUBLE) AS g, CAST(event_id % 256 AS DOUBLE) AS b, CAST((k * 7) % 256 AS DOUBLE) AS s,
  CAST(CAST(floor(value * 3) AS BIGINT) % 256 AS DOUBLE) AS v FROM seq"""
_RATIO_SQL = """SELECT video_id || ':' || frame AS vf,
  least(greatest(100.0 * (greatest(r, g, b) - (r + g + b) / 3.0) / (1.0 + (r + g + b) / 3.0), 1.0), 199.0) AS rgb_ratio,
  255.0 * v / max(v + 1.0) OVER (PARTITION BY video_id, frame) AS v_norm FROM pix"""


@register("a13_rgb_ratio_histogram", _q(_hist_sql("ratio", "vf", "rgb_ratio", -1, 40, 5), pix=_PIX_SQL,
                                        ratio=_RATIO_SQL))
def a13_rgb_ratio_histogram(spark, sf):
    c = FR.colour_ratios(_pixels(spark, sf), ["video_id", "frame"]).withColumn(
        "vf", F.concat_ws(":", F.col("video_id").cast("string"), F.col("frame").cast("string")))
    return FR.histogram(c, ["vf"], "rgb_ratio", -1, 40, 5)


@register("a13_value_norm_histogram", _q(_hist_sql("ratio", "vf", "v_norm", -1, 32, 8), pix=_PIX_SQL,
                                         ratio=_RATIO_SQL))
def a13_value_norm_histogram(spark, sf):
    c = FR.colour_ratios(_pixels(spark, sf), ["video_id", "frame"]).withColumn(
        "vf", F.concat_ws(":", F.col("video_id").cast("string"), F.col("frame").cast("string")))
    return FR.histogram(c, ["vf"], "v_norm", -1, 32, 8)


# ---- W9 / W10 -------------------------------------------------------------------------------
@register("w09_vector_frame_diff", """
SELECT vec_id, label, CASE WHEN p IS NULL THEN 0.0 ELSE floor((list_sum(list_transform(range(1, len(e) + 1),
  lambda i: abs(CAST(e[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)))) / len(e)) * 1e6 + 0.5) / 1e6 END AS frame_diff
FROM (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)""")
def w09_vector_frame_diff(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return FR.vector_frame_diff(e, ["label"], ["vec_id"], "embedding", "blocked",
                                F.floor(F.col("vec_id") / POS_BUCKET)).select("vec_id", "label", "frame_diff")


@register("w10_grey_change", _q("""
SELECT video_id, frame, floor((sum(t) / count(*)) * 1e6 + 0.5) / 1e6 AS gray_diff FROM (
  SELECT video_id, frame, CASE WHEN d < 50 THEN 0 WHEN d > 50 THEN 1 ELSE 50 END AS t FROM (
    SELECT video_id, r // 4 AS frame, ((lag(g) OVER (PARTITION BY video_id, r % 4 ORDER BY r // 4) - g) % 256 + 256) % 256 AS d
    FROM (SELECT *, CAST(floor(value) AS BIGINT) % 256 AS g FROM seq)) WHERE d IS NOT NULL)
GROUP BY 1, 2"""))
def w10_grey_change(spark, sf):
    s = _seq(spark, sf).select("video_id", F.floor(F.col("r") / 4).alias("frame"), (F.col("r") % 4).alias("pixel"),
                               F.pmod(F.floor("value"), F.lit(256)).alias("g"))
    return FR.grey_change(s, ["video_id"], "frame", "pixel", "g")


# ---- W11 / W12 / W13 / W22 ----------------------------------------------------------------------
def _shot_frames(spark, sf):
    s = _seq(spark, sf)
    return s.select("video_id", (F.col("r") * 200).alias("ts_ms"), (F.col("value") / 500).alias("mag_mu"),
                    ((F.col("k") % 100) / 100).alias("gray_diff"), ((F.col("event_id") % 7) / 100).alias("f_diff"))


_SHOT_SQL = """SELECT video_id, r * 200 AS ts_ms, value / 500 AS mag_mu, (k % 100) / 100 AS gray_diff,
  (event_id % 7) / 100 AS f_diff FROM seq"""
_CAND_SQL = """SELECT video_id, ts_ms FROM shotf WHERE (CASE WHEN mag_mu > 0.08 THEN 1 ELSE 0 END
  + CASE WHEN gray_diff > 0.65 THEN 1 ELSE 0 END + CASE WHEN f_diff > 0.02 THEN 1 ELSE 0 END) >= 2"""
_ACC_SQL = """SELECT video_id, min(ts_ms) AS ts_ms FROM cand WHERE ts_ms > 1100 GROUP BY video_id
  UNION ALL
  SELECT c.video_id, min(c.ts_ms) FROM acc a JOIN cand c ON c.video_id = a.video_id AND c.ts_ms > a.ts_ms + 1100
  GROUP BY c.video_id"""


def _accepted(spark, sf):
    fr = _shot_frames(spark, sf)
    return fr, accept_with_gap_blocks(fr.filter(FR.shot_votes(fr)), ["video_id"], "ts_ms", 1100)


@register("w11_shot_changes", "WITH RECURSIVE " + ",\n".join([
    f"events_k AS ({EVENTS_K_SQL})", f"seq AS ({SEQ_SQL})", f"shotf AS ({_SHOT_SQL})", f"cand AS ({_CAND_SQL})",
    f"acc(video_id, ts_ms) AS ({_ACC_SQL})"]) + "\nSELECT video_id, ts_ms FROM acc")
def w11_shot_changes(spark, sf):
    return _accepted(spark, sf)[1]


@register("w11_shot_changes_doubling", "WITH RECURSIVE " + ",\n".join([
    f"events_k AS ({EVENTS_K_SQL})", f"seq AS ({SEQ_SQL})", f"shotf AS ({_SHOT_SQL})", f"cand AS ({_CAND_SQL})",
    f"acc(video_id, ts_ms) AS ({_ACC_SQL})"]) + "\nSELECT video_id, ts_ms FROM acc")
def w11_shot_changes_doubling(spark, sf):
    """W11 under its second key (there is one plan)."""
    return _accepted(spark, sf)[1]


@register("w12_shot_durations", "WITH RECURSIVE " + ",\n".join([
    f"events_k AS ({EVENTS_K_SQL})", f"seq AS ({SEQ_SQL})", f"shotf AS ({_SHOT_SQL})", f"cand AS ({_CAND_SQL})",
    f"acc(video_id, ts_ms) AS ({_ACC_SQL})"]) + """
SELECT video_id, ts_ms, shot_id, floor((count(*) OVER (PARTITION BY video_id, shot_id) * 0.2::DOUBLE) * 1e6 + 0.5) / 1e6 AS shot_duration
FROM (SELECT f.video_id, f.ts_ms, CAST(coalesce(sum(CASE WHEN a.ts_ms IS NOT NULL THEN 1 ELSE 0 END) OVER (
        PARTITION BY f.video_id ORDER BY f.ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shot_id
      FROM shotf f LEFT JOIN acc a USING (video_id, ts_ms))""")
def w12_shot_durations(spark, sf):
    fr, acc = _accepted(spark, sf)
    marked = fr.select("video_id", "ts_ms").join(acc.withColumn("change", F.lit(True)), ["video_id", "ts_ms"], "left")
    marked = marked.withColumn("change", F.coalesce("change", F.lit(False)))
    return FR.shot_durations(marked, ["video_id"], "ts_ms", "change", strategy="blocked",
                             bucket=F.floor(F.col("ts_ms") / (200 * POS_BUCKET))).select(
        "video_id", "ts_ms", "shot_id", "shot_duration")


_TS25 = "r * 40 + (event_id % 3) * 13"


@register("w13_downsample", _q(f"""SELECT video_id, ts_ms FROM (
  SELECT video_id, {_TS25} AS ts_ms, row_number() OVER (PARTITION BY video_id, floor(({_TS25}) / 200)
    ORDER BY {_TS25}) AS rn FROM seq) WHERE rn = 1"""))
def w13_downsample(spark, sf):
    s = _seq(spark, sf).select("video_id", (F.col("r") * 40 + (F.col("event_id") % 3) * 13).alias("ts_ms"))
    return FR.downsample(s, ["video_id"], "ts_ms", 200)


@register("w22_frame_counter", _q(f"""SELECT video_id, ts_ms,
  row_number() OVER (PARTITION BY video_id ORDER BY ts_ms) AS count_process FROM (
  SELECT video_id, {_TS25} AS ts_ms, row_number() OVER (PARTITION BY video_id, floor(({_TS25}) / 200)
    ORDER BY {_TS25}) AS rn FROM seq) WHERE rn = 1"""))
def w22_frame_counter(spark, sf):
    s = _seq(spark, sf).select("video_id", (F.col("r") * 40 + (F.col("event_id") % 3) * 13).alias("ts_ms"))
    return FR.frame_counter(FR.downsample(s, ["video_id"], "ts_ms", 200), ["video_id"], "ts_ms", "blocked",
                            F.floor(F.col("ts_ms") / (40 * POS_BUCKET)))


# ---- W14 / J14 / A10 / W15 / A8 / A9 -----------------------------------------------------------
W = 3
_DETS_SQL = """SELECT video_id, r // 4 AS frame, r % 4 AS det, CAST([1, 5, 17, 62][k % 4 + 1] AS INTEGER) AS label,
  0.1::DOUBLE AS bl, 0.1::DOUBLE AS bb, 0.5::DOUBLE + 0.02::DOUBLE * (k % 5) AS br,
  0.5::DOUBLE + 0.01::DOUBLE * (event_id % 5) AS bt, sqrt((k + 1) / 100.0::DOUBLE) AS conf FROM seq"""


def _dets(spark, sf):
    s = _seq(spark, sf)
    label = F.get(F.array(*[F.lit(x) for x in (1, 5, 17, 62)]), (F.col("k") % 4).cast("int"))
    box = F.struct(F.lit(0.1).alias("l"), F.lit(0.1).alias("b"), (F.lit(0.5) + F.lit(0.02) * (F.col("k") % 5)).alias("r"),
                   (F.lit(0.5) + F.lit(0.01) * (F.col("event_id") % 5)).alias("t"))
    return s.select("video_id", F.floor(F.col("r") / 4).alias("frame"), (F.col("r") % 4).alias("det"),
                    label.alias("label"), box.alias("box"), F.sqrt((F.col("k") + 1) / 100.0).alias("conf"))


_OV = """2.0 * CASE WHEN least(a.bl + a.br, f.bl + f.br) - greatest(a.bl, f.bl) > 0
  AND least(a.bb + a.bt, f.bb + f.bt) - greatest(a.bb, f.bb) > 0
  THEN (least(a.bl + a.br, f.bl + f.br) - greatest(a.bl, f.bl)) * (least(a.bb + a.bt, f.bb + f.bt) - greatest(a.bb, f.bb))
  ELSE 0.0 END / (a.br * a.bt + f.br * f.bt)"""
_SMOOTH_SQL = dict(
    dets=_DETS_SQL,
    nf="SELECT video_id, max(frame) + 1 AS n FROM dets GROUP BY 1",
    anc=f"SELECT d.* FROM dets d JOIN nf USING (video_id) WHERE frame <= n - {W}",
    tr=f"""SELECT a.video_id, a.frame AS group_start, a.det AS a_det, a.label, a.frame, a.det, a.bl, a.bb, a.br, a.bt, a.conf
  FROM anc a UNION ALL
  SELECT a.video_id, a.frame, a.det, a.label, f.frame, f.det, f.bl, f.bb, f.br, f.bt, f.conf
  FROM anc a JOIN dets f ON f.video_id = a.video_id AND f.label = a.label AND f.frame BETWEEN a.frame + 1 AND a.frame + {W - 1}
  WHERE {_OV} BETWEEN 0.8 AND 1""",
    sm=f"""SELECT video_id, group_start, a_det, label, floor((mconf) * 1e6 + 0.5) / 1e6 AS conf, mconf AS conf_raw, bl AS box_l, bb AS box_b, br AS box_r,
  bt AS box_t FROM (SELECT *, row_number() OVER g2 AS rn, count(*) OVER g AS n_rows, avg(conf) OVER g AS mconf FROM tr
  WINDOW g AS (PARTITION BY video_id, group_start, a_det), g2 AS (PARTITION BY video_id, group_start, a_det
  ORDER BY bl * bb * br * bt, frame, det)) WHERE rn = 1 AND n_rows >= {W} AND mconf >= 0.5""")


def _smoothed(spark, sf):
    return OB.smooth_object_confidence(_dets(spark, sf), ["video_id"], W, 0.8, 0.5, "raw")


def _flat(df):
    return df.select("video_id", "group_start", "a_det", "label", r6("conf").alias("conf"),
                     F.col("box.l").alias("box_l"),
                     F.col("box.b").alias("box_b"), F.col("box.r").alias("box_r"), F.col("box.t").alias("box_t"))


@register("w14_window_starts", _q(f"""SELECT video_id, frame, unnest(range(greatest(frame - {W - 1}, 0),
  least(frame, n - {W}) + 1)) AS group_start FROM (SELECT DISTINCT video_id, r // 4 AS frame FROM seq)
  JOIN (SELECT video_id, max(r // 4) + 1 AS n FROM seq GROUP BY 1) USING (video_id)
  WHERE least(frame, n - {W}) >= greatest(frame - {W - 1}, 0)"""))
def w14_window_starts(spark, sf):
    s = _seq(spark, sf).select("video_id", F.floor(F.col("r") / 4).alias("frame")).distinct()
    n = s.groupBy("video_id").agg((F.max("frame") + 1).alias("n_frames"))
    return OB.window_starts(s.join(n, "video_id"), ["video_id"], "frame", "n_frames", W).select(
        "video_id", "frame", "group_start")


@register("j14_object_tracks", _q(f"""SELECT video_id, group_start, a_det, label, frame, det FROM tr""",
                                  **_SMOOTH_SQL))
def j14_object_tracks(spark, sf):
    return OB.track_objects(_dets(spark, sf), ["video_id"], W, 0.8, "raw").select(
        "video_id", "group_start", "a_det", "label", "frame", "det")


@register("w15_object_smoothing", _q("SELECT * EXCLUDE (conf_raw) FROM sm", **_SMOOTH_SQL))
def w15_object_smoothing(spark, sf):
    return _flat(_smoothed(spark, sf))


@register("a10_smooth_confidences", _q("SELECT video_id, group_start, a_det, label, conf FROM sm", **_SMOOTH_SQL))
def a10_smooth_confidences(spark, sf):
    return _smoothed(spark, sf).select("video_id", "group_start", "a_det", "label", r6("conf").alias("conf"))


_SUPER_SQL = ("CASE " + " ".join(
    f"WHEN label BETWEEN {lo} AND {hi} THEN {i}" for i, (lo, hi) in enumerate(
        zip([1] + [x + 1 for x in X.SUPER_CATEGORY_LAST_LABEL[:-1]], X.SUPER_CATEGORY_LAST_LABEL), start=1)) + " END")
_AR_SQL = "(CAST(trunc((box_r - box_l) * 300) AS BIGINT) * CAST(trunc((box_t - box_b) * 300) AS BIGINT))"


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


@register("a08_object_features", _q(f"""
SELECT g.video_id, CAST(g.category AS INTEGER) AS category, {_r6("coalesce(c.cnt, 0) / g.n_frames")} AS labels_freq,
  {_r6("coalesce(c.sc / c.cnt, 0.0)")} AS labels_avg_confidence,
  {_r6("coalesce(c.sa, 0) / 90000.0::DOUBLE / g.n_frames")} AS labels_area_ratio
FROM (SELECT video_id, n - {W} + 1 AS n_frames, unnest(range(1, 13)) AS category FROM nf WHERE n >= {W}) g
LEFT JOIN (SELECT video_id, {_SUPER_SQL} AS category, count(*) AS cnt, sum(conf_raw) AS sc, sum({_AR_SQL}) AS sa
           FROM sm GROUP BY 1, 2) c USING (video_id, category)""", **_SMOOTH_SQL))
def a08_object_features(spark, sf):
    d = _dets(spark, sf)
    n = (d.groupBy("video_id").agg((F.max("frame") + 1).alias("n")).filter(F.col("n") >= W)
         .select("video_id", (F.col("n") - W + 1).alias("n_frames")))
    return OB.object_features(_smoothed(spark, sf), n, ["video_id"], "super")


@register("a09_object_features_per_frame", _q(f"""
SELECT g.video_id, g.group_start, CAST(g.category AS INTEGER) AS category, CAST(coalesce(c.cnt, 0) AS BIGINT) AS freq,
  {_r6("coalesce(c.sc / c.cnt, 0.0)")} AS avg_confidence, {_r6("coalesce(c.sa, 0) / 90000.0::DOUBLE")} AS area_ratio
FROM (SELECT video_id, unnest(range(0, n - {W} + 1)) AS group_start FROM nf WHERE n >= {W}) f,
     LATERAL (SELECT f.video_id, f.group_start, unnest(range(1, 13)) AS category) g
LEFT JOIN (SELECT video_id, group_start, {_SUPER_SQL} AS category, count(*) AS cnt, sum(conf_raw) AS sc,
                  sum({_AR_SQL}) AS sa FROM sm GROUP BY 1, 2, 3) c
ON c.video_id = g.video_id AND c.group_start = g.group_start AND c.category = g.category""", **_SMOOTH_SQL))
def a09_object_features_per_frame(spark, sf):
    d = _dets(spark, sf)
    n = d.groupBy("video_id").agg((F.max("frame") + 1).alias("n")).filter(F.col("n") >= W)
    starts = n.select("video_id", F.explode(F.sequence(F.lit(0), F.col("n") - W)).alias("group_start"))
    return OB.object_features_per_frame(_smoothed(spark, sf), starts, ["video_id"], "super")


# ---- J15 overlap suppression --------------------------------------------------------------
@register("j15_remove_overlaps", _q("""
SELECT video_id, frame, idx FROM rr a WHERE NOT EXISTS (
  SELECT 1 FROM rr b WHERE b.video_id = a.video_id AND b.frame = a.frame AND b.idx > a.idx AND
  2.0 * CASE WHEN least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 0 AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0
    THEN (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))
    ELSE 0.0 END / (a.w * a.h + b.w * b.h) > 0.3)""", rects=RECTS_SQL,
                                    rr="""SELECT user_id AS video_id, x, y, w, h,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS frame,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4 AS idx FROM rects"""))
def j15_remove_overlaps(spark, sf):
    r = rects(spark, sf).withColumnRenamed("user_id", "video_id")
    r = sequence_index(r, ["video_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), out="_p")
    r = r.select("video_id", F.floor(F.col("_p") / 4).alias("frame"),
                                       (F.col("_p") % 4).alias("idx"), "rect")
    return OB.remove_overlaps(r, ["video_id", "frame"], "idx", "rect", 0.3).select("video_id", "frame", "idx")
