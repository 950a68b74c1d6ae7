"""Queries for scalar / geometry functions (T15-T26, J16) and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6

from reelforge.functions import scalar as X
from reelforge.plans.adapters import (CHUNKS_SQL, EVENTS_K_SQL, RECTS_SQL, chunks, events_k, rects, with_ctes)
from reelforge.operators.sequence import neighbour_window, sequence_index
from reelforge.plans.registry import register
from reelforge.session import read_table

_START = "event_id * 7919"
_END = "event_id * 7919 + CAST(floor(value * 1000) AS BIGINT)"


def _clip(spark, sf):
    e = read_table(spark, sf, "events")
    start = F.col("event_id") * 7919
    return e.select("event_id", "value", start.alias("start"), (start + F.floor(F.col("value") * 1000)).alias("end"))


@register("t15_clip_length", f"SELECT event_id, round_even(({_END}) / 1000 - ({_START}) / 1000, 0) AS length_s FROM events")
def t15_clip_length(spark, sf):
    return _clip(spark, sf).select("event_id", X.clip_length_s("start", "end").alias("length_s"))


@register("t16_n_pieces", f"""SELECT event_id,
  CAST(floor(round_even(({_END}) / 1000 - ({_START}) / 1000, 0) / 15) AS BIGINT) AS n_pieces FROM events""")
def t16_n_pieces(spark, sf):
    return _clip(spark, sf).select("event_id", X.n_pieces(X.clip_length_s("start", "end")).alias("n_pieces"))


@register("t17_seconds_to_time", """SELECT event_id,
  CAST(trunc(value * 10 / 3600) AS BIGINT) AS hrs, CAST(trunc(value * 10 / 60) AS BIGINT) AS mins,
  CAST(trunc(value * 10) AS BIGINT) % 60 AS secs,
  CAST(trunc(100 * (value * 10 - trunc(value * 10))) AS BIGINT) AS hundredths FROM events""")
def t17_seconds_to_time(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", X.seconds_to_time(F.col("value") * 10).alias("t")).select("event_id", "t.*")


_DICT_SQL = "'{''spotify'': ''https://open.example/track/' || k || ''', ''uri'': ''x' || event_id || '''}'"


@register("t18_dict_url", with_ctes(f"""SELECT event_id,
  json_extract_string(replace({_DICT_SQL}, '''', '"'), '$.spotify') AS url FROM events_k""", events_k=EVENTS_K_SQL))
def t18_dict_url(spark, sf):
    e = events_k(spark, sf)
    text = F.concat(F.lit("{'spotify': 'https://open.example/track/"), "k", F.lit("', 'uri': 'x"), "event_id",
                    F.lit("'}"))
    return e.select("event_id", X.dict_value(text, "spotify").alias("url"))


@register("t19_decode_name", with_ctes("""SELECT event_id, decode(encode(event_type || '_' || k || '_é')) AS song_name
FROM events_k""", events_k=EVENTS_K_SQL))
def t19_decode_name(spark, sf):
    e = events_k(spark, sf)
    raw = F.encode(F.concat("event_type", F.lit("_"), "k", F.lit("_é")), "UTF-8")
    return e.select("event_id", X.decode_utf8(raw).alias("song_name"))


def _dirty(e):
    return (F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).when(F.col("k") % 10 == 1, F.lit(float("inf")))
            .when(F.col("k") % 10 == 2, F.lit(float("-inf"))).otherwise(F.col("value")))


_DIRTY_SQL = ("CASE WHEN k % 10 = 0 THEN 'NaN'::DOUBLE WHEN k % 10 = 1 THEN 'inf'::DOUBLE "
              "WHEN k % 10 = 2 THEN '-inf'::DOUBLE ELSE value END")


@register("t20_finite_or_null", with_ctes(f"""SELECT event_id,
  CASE WHEN isnan({_DIRTY_SQL}) OR isinf({_DIRTY_SQL}) THEN NULL ELSE {_DIRTY_SQL} END AS value FROM events_k""",
                                          events_k=EVENTS_K_SQL))
def t20_finite_or_null(spark, sf):
    e = events_k(spark, sf)
    return e.select("event_id", X.finite_or_null(_dirty(e)).alias("value"))


@register("t21_to_decimal", """SELECT event_id, TRY_CAST(value / 10 AS DECIMAL(7,5)) AS d_small,
  TRY_CAST(value AS DECIMAL(7,5)) AS d_big, TRY_CAST(value AS DECIMAL(9,5)) AS d_wide FROM events""")
def t21_to_decimal(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", X.to_decimal(F.col("value") / 10).alias("d_small"),
                    X.to_decimal("value").alias("d_big"), X.to_decimal("value", 9, 5).alias("d_wide"))


@register("t22_constants_renames", """SELECT o_orderkey AS id, o_custkey AS video_id, 1 AS real,
  'mp4' AS video_type, o_orderstatus FROM orders""")
def t22_constants_renames(spark, sf):
    o = read_table(spark, sf, "orders")
    return (o.withColumns({"real": F.lit(1), "video_type": F.lit("mp4")})
            .withColumnsRenamed({"o_orderkey": "id", "o_custkey": "video_id"})
            .drop("o_totalprice", "o_orderdate", "o_orderpriority"))


_LABEL_SQL = "(1 + k % 80)"
_SUPER_SQL = ("CAST(CASE " + " ".join(
    f"WHEN {_LABEL_SQL} BETWEEN {lo} AND {hi} THEN {i}" for i, (lo, hi) in enumerate(
        zip([1] + [x + 1 for x in X.SUPER_CATEGORY_LAST_LABEL[:-1]], X.SUPER_CATEGORY_LAST_LABEL), start=1))
    + " END AS INTEGER)")


@register("t23_super_category", with_ctes(f"""SELECT event_id, {_LABEL_SQL} AS label, {_SUPER_SQL} AS super_category
FROM events_k""", events_k=EVENTS_K_SQL))
def t23_super_category(spark, sf):
    e = events_k(spark, sf)
    lab = (1 + F.col("k") % 80).cast("int")
    return e.select("event_id", lab.alias("label"), X.super_category(lab).alias("super_category"))


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in X.CATEGORY_NAMES) + "]"


@register("j16_category_names", with_ctes(f"""SELECT event_id, {_LABEL_SQL} AS label,
  {_NAMES_SQL}[{_LABEL_SQL}] AS label_name FROM events_k""", events_k=EVENTS_K_SQL))
def j16_category_names(spark, sf):
    e = events_k(spark, sf)
    lab = (1 + F.col("k") % 80).cast("int")
    return e.select("event_id", lab.alias("label"), X.category_name(lab).alias("label_name"))


@register("t24_rect_area", with_ctes("SELECT event_id, x * y * w * h AS area FROM rects",
                                     events_k=EVENTS_K_SQL, rects=RECTS_SQL))
def t24_rect_area(spark, sf):
    return rects(spark, sf).select("event_id", X.rect_area("rect").alias("area"))


@register("t25_overlap_ratio", with_ctes("""SELECT event_id,
  floor((2.0 * CASE WHEN least(x + w, px + pw) - greatest(x, px) > 0 AND least(y + h, py + ph) - greatest(y, py) > 0
    THEN (least(x + w, px + pw) - greatest(x, px)) * (least(y + h, py + ph) - greatest(y, py)) ELSE 0.0 END
    / (w * h + pw * ph)) * 1e6 + 0.5) / 1e6 AS overlap
FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(w) OVER w AS pw, lag(h) OVER w AS ph
      FROM rects WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
                                         events_k=EVENTS_K_SQL, rects=RECTS_SQL))
def t25_overlap_ratio(spark, sf):
    r = sequence_index(rects(spark, sf), ["user_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), out="_p")
    r = neighbour_window(r, ["user_id"], "_p", ["rect"], 1)
    return r.select("event_id", r6(X.overlap_ratio("rect", F.col("rect_m1"))).alias("overlap"))


@register("t26_angle_diff", with_ctes("""SELECT event_id,
  CASE WHEN abs((k * 7) % 360 - value % 360) > 180 THEN abs((k * 7) % 360 - value % 360) - 360
       ELSE abs((k * 7) % 360 - value % 360) END AS angle_diff FROM events_k""", events_k=EVENTS_K_SQL))
def t26_angle_diff(spark, sf):
    e = events_k(spark, sf)
    return e.select("event_id", X.angle_diff(F.col("value") % 360, (F.col("k") * 7) % 360).alias("angle_diff"))


# ---- filters ------------------------------------------------------------------
@register("f01_not_null", with_ctes("SELECT video_id, start, song_id FROM chunks WHERE song_id IS NOT NULL",
                                    chunks=CHUNKS_SQL))
def f01_not_null(spark, sf):
    return chunks(spark, sf).filter(F.col("song_id").isNotNull()).select("video_id", "start", "song_id")


F02_LO, F02_HI = 1000.0, 100000.0


@register("f02_range_inclusive", f"""SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice BETWEEN {F02_LO} AND {F02_HI}""")
def f02_range_inclusive(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.filter(F.col("o_totalprice").between(F02_LO, F02_HI)).select("o_orderkey", "o_totalprice")


@register("f03_unprocessed", """SELECT o_orderkey FROM
(SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS searched FROM orders) WHERE searched = 0""")
def f03_unprocessed(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("searched"))
    return o.filter(F.col("searched") == 0).select("o_orderkey")


@register("f04_multi_track_albums", """SELECT l_orderkey AS album_id, count(*) AS total_tracks FROM lineitem
GROUP BY l_orderkey HAVING count(*) > 1""")
def f04_multi_track_albums(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("album_id")).agg(F.count(F.lit(1)).alias("total_tracks"))
            .filter(F.col("total_tracks") > 1))


_TRACK_SQL = ("CASE WHEN k % 7 = 0 THEN event_type || ' Drums' WHEN k % 7 = 1 THEN 'PERCUSSION ' || event_type "
              "WHEN k % 7 = 2 THEN NULL ELSE event_type || ' piano' END")


@register("f08_drop_percussion", with_ctes(f"""SELECT event_id, {_TRACK_SQL} AS track_name FROM events_k
WHERE coalesce(NOT regexp_matches(lower({_TRACK_SQL}), 'drums|percussion'), true)""", events_k=EVENTS_K_SQL))
def f08_drop_percussion(spark, sf):
    e = events_k(spark, sf)
    k = F.col("k")
    name = (F.when(k % 7 == 0, F.concat("event_type", F.lit(" Drums")))
            .when(k % 7 == 1, F.concat(F.lit("PERCUSSION "), "event_type"))
            .when(k % 7 == 2, F.lit(None).cast("string"))
            .otherwise(F.concat("event_type", F.lit(" piano"))))
    t = e.select("event_id", name.alias("track_name"))
    return t.filter(F.coalesce(~F.lower("track_name").rlike("drums|percussion"), F.lit(True)))
