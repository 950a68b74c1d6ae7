"""Queries for nested data (L1-L4, L6) and sources / sinks with SQL-checkable output."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import nested as NS
from reelforge.functions.scalar import SUPER_CATEGORY_NAMES
from reelforge.plans.adapters import EVENTS_K_SQL, events_k, with_ctes
from reelforge.plans.registry import register
from reelforge.session import read_table
from reelforge.sources import tables as TB


# ---- L1 / F4: album search results as JSON documents, one per conversation turn ------
def _albums_json(spark, sf):
    c = read_table(spark, sf, "conversations")
    item = lambda i, name, n: F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(str(i))).alias("id"),
        name.alias("name"), n.cast("int").alias("total_tracks"))
    doc = F.struct(F.struct(F.array(item(0, F.col("role"), F.col("turn")),
                                    item(1, F.upper("role"), F.length("text") % 7)).alias("items")).alias("albums"))
    return c.select("conv_id", "turn", F.to_json(doc).alias("json"))


_L1_SQL = """SELECT conv_id, turn, conv_id || '-' || turn || '-0' AS id, role AS name, CAST(turn AS INTEGER) AS total_tracks
FROM conversations UNION ALL
SELECT conv_id, turn, conv_id || '-' || turn || '-1', upper(role), CAST(length(text) % 7 AS INTEGER) FROM conversations"""


@register("l01_json_records", _L1_SQL)
def l01_json_records(spark, sf):
    return NS.json_records(_albums_json(spark, sf), "json", NS.ALBUMS_SCHEMA, ["albums", "items"], ["conv_id", "turn"])


@register("f04_albums_with_tracks", f"SELECT * FROM ({_L1_SQL}) WHERE total_tracks > 1")
def f04_albums_with_tracks(spark, sf):
    r = NS.json_records(_albums_json(spark, sf), "json", NS.ALBUMS_SCHEMA, ["albums", "items"], ["conv_id", "turn"])
    return r.filter(F.col("total_tracks") > 1)


# ---- L2: playlist tracks ---------------------------------------------------------------
def _playlist_json(spark, sf):
    c = read_table(spark, sf, "conversations")
    url = lambda s: F.concat(F.lit("https://open.example/track/"), F.col("conv_id").cast("string"),
                             F.lit("-"), F.col("turn").cast("string"), F.lit(s))
    artist = lambda n: F.struct(n.alias("name"))
    arts = F.when(F.col("turn") % 3 == 0, F.array().cast("array<struct<name:string>>")).otherwise(
        F.array(artist(F.concat(F.lit("a"), F.col("conv_id").cast("string"))), artist(F.lit("b"))))
    t0 = F.struct(F.struct(F.col("role").alias("name"), arts.alias("artists"),
                           F.struct(url("").alias("spotify")).alias("external_urls")).alias("track"))
    t1 = F.struct(F.struct(F.lit("echo").alias("name"), F.array(artist(F.col("role"))).alias("artists"),
                           F.struct(url("x").alias("spotify")).alias("external_urls")).alias("track"))
    doc = F.struct(F.struct(F.array(t0, t1).alias("items")).alias("tracks"))
    return c.select("conv_id", "turn", F.to_json(doc).alias("json"))


@register("l02_playlist_tracks", """
SELECT conv_id, turn, 0 AS track_pos, role AS track_name, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'a' || conv_id END AS artist,
  'https://open.example/track/' || conv_id || '-' || turn AS url FROM conversations
UNION ALL
SELECT conv_id, turn, 1, 'echo', role, 'https://open.example/track/' || conv_id || '-' || turn || 'x' FROM conversations""")
def l02_playlist_tracks(spark, sf):
    return NS.playlist_tracks(_playlist_json(spark, sf), "json", ["conv_id", "turn"])


# ---- L3 / L4 / L6 -----------------------------------------------------------------------
@register("l03_first_map_key", with_ctes("""SELECT event_id,
  json_keys('{"song_' || k || '": 1, "other": 2}')[1] AS first_key FROM events_k""", events_k=EVENTS_K_SQL))
def l03_first_map_key(spark, sf):
    e = events_k(spark, sf)
    m = F.from_json(F.concat(F.lit('{"song_'), F.col("k").cast("string"), F.lit('": 1, "other": 2}')),
                    "map<string,int>")
    return e.select("event_id", NS.first_map_key(m).alias("first_key"))


@register("l04_vector_concat", """SELECT vec_id,
  list_concat(CAST(embedding AS DOUBLE[]), [CAST(label AS DOUBLE)]) AS vec FROM embeddings""")
def l04_vector_concat(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", NS.concat_vectors(F.col("embedding").cast("array<double>"),
                                                F.array(F.col("label").cast("double"))).alias("vec"))


DIMS = 64


@register("l06_vector_to_columns", "SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(DIMS)) + " FROM embeddings")
def l06_vector_to_columns(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", *NS.vector_to_columns("v", [f"e{i}" for i in range(DIMS)]))


@register("l06_columns_to_vector", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings")
def l06_columns_to_vector(spark, sf):
    names = [f"e{i}" for i in range(DIMS)]
    wide = l06_vector_to_columns(spark, sf)
    return wide.select("vec_id", NS.columns_to_vector(names, "vector"))


# ---- S7 / S8 / S9 / S10 ------------------------------------------------------------------
@register("s07_feature_lines", """SELECT vec_id || '.npy' || chr(9) ||
  array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), chr(9)) || chr(9) AS line
FROM embeddings""")
def s07_feature_lines(spark, sf):
    e = read_table(spark, sf, "embeddings").select(
        F.concat(F.lit("/data/vectors/"), F.col("vec_id").cast("string"), F.lit(".npy")).alias("name"), "embedding")
    return TB.feature_lines(e, "name", "embedding")


def _s8_sql() -> str:
    from reelforge.plans import q_frames  # noqa: F401  (registers a08)
    from reelforge.plans.registry import _ORACLE
    a08 = _ORACLE["a08_object_features"]
    cols = ", ".join(f"max(CASE WHEN category = {i} THEN v END) AS \"{n}\""
                     for i, n in enumerate(SUPER_CATEGORY_NAMES, start=1))
    body = a08.replace("\nSELECT g.video_id, CAST(g.category AS INTEGER) AS category,",
                       "\n, a8 AS (SELECT g.video_id, CAST(g.category AS INTEGER) AS category,", 1)
    return (body + f""")
SELECT video_id, metric, {cols} FROM (
  SELECT video_id, category, 'labels_freq' AS metric, labels_freq AS v FROM a8 UNION ALL
  SELECT video_id, category, 'labels_avg_confidence', labels_avg_confidence FROM a8 UNION ALL
  SELECT video_id, category, 'labels_area_ratio', labels_area_ratio FROM a8) GROUP BY 1, 2""")


@register("s08_object_metric_table", _s8_sql())
def s08_object_metric_table(spark, sf):
    from reelforge.plans.q_frames import a08_object_features
    stats = a08_object_features(spark, sf)
    return TB.metric_table(stats, ["video_id"], "category",
                           ["labels_freq", "labels_avg_confidence", "labels_area_ratio"], SUPER_CATEGORY_NAMES)


@register("s09_whole_table_read", "SELECT * FROM lineitem")
def s09_whole_table_read(spark, sf):
    return TB.read_table(spark, f"{sf.rstrip('/')}/lineitem.parquet")


S10_TEXT = """SELECT o.o_orderstatus AS status, count(*) AS n_lines, sum(l.l_quantity) AS qty
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus"""


@register("s10_sql_text", S10_TEXT.format(lineitem="lineitem", orders="orders"))
def s10_sql_text(spark, sf):
    views = {"lineitem": read_table(spark, sf, "lineitem"), "orders": read_table(spark, sf, "orders")}
    return TB.run_sql(spark, S10_TEXT, views)
