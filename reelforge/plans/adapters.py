"""Adapters: derive each operator's input table from the given test tables.

Every adapter exists twice, once as a Spark plan (used by ``queries()``) and
once as DuckDB SQL text (used as a CTE by ``oracle_sql()``), and both follow
the same written rule, so the oracle checks the operator, not the adapter.
All adapters read whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6

from reelforge.operators.sequence import sequence_index
from reelforge.session import read_table

# Event type -> label code (error = no recognised label).
EVENT_LABELS = {"click": 1, "purchase": 2, "signup": 3, "view": 4}
CHUNK_MS = 5000


def _label_expr(col: str = "event_type"):
    e = None
    for name, code in EVENT_LABELS.items():
        e = F.when(F.col(col) == name, F.lit(code)) if e is None else e.when(F.col(col) == name, F.lit(code))
    return e.cast("int")


_LABEL_SQL = ("CAST(CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_LABELS.items())
              + " END AS INTEGER)")


# --------------------------------------------------------------------------- chunks
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk-match sequence: one 5 s chunk per event, per user ("video").
    Positions are numbered per (user, hour) with carried counts, so no task
    holds a whole user."""
    ev = (read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
          .withColumnRenamed("user_id", "video_id"))
    ev = sequence_index(ev, ["video_id"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), out="_idx")
    idx = F.col("_idx")
    label = _label_expr()
    return ev.select(
        "video_id",
        (idx * CHUNK_MS).alias("start"),
        ((idx + 1) * CHUNK_MS).alias("end"),
        label.alias("song_id"),
        F.when(label.isNotNull(), F.floor(F.col("value") / 50).cast("double")).alias("offset_seconds"),
    )


CHUNKS_SQL = f"""
SELECT user_id AS video_id,
       CAST({CHUNK_MS} * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS BIGINT) AS start,
       CAST({CHUNK_MS} * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS "end",
       {_LABEL_SQL} AS song_id,
       CASE WHEN event_type IN ({", ".join(f"'{k}'" for k in EVENT_LABELS)})
            THEN CAST(floor(value / 50) AS DOUBLE) END AS offset_seconds
FROM events
"""


def with_ctes(body: str, **ctes: str) -> str:
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {parts}\n{body}" if ctes else body


# --------------------------------------------------------------------------- file paths
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages.url without scheme, query, fragment and trailing slashes."""
    u = F.col("url")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z]+://", ""), r"[?#].*$", ""), r"/+$", "")
    return read_table(spark, sf_dir, "pages").select("page_id", p.alias("path"))


PATHS_SQL = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', ''), '/+$', '') AS path
FROM pages
"""
PATH_SPLIT_SQL = r"""
SELECT page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory,
       regexp_extract(path, '([^/]*)$', 1) AS filename
FROM paths
"""

# --------------------------------------------------------------------------- file titles
# Fixed values of the adapter: suffix chosen by p_partkey mod 5.
PART_SUFFIXES = [".mid", ".MP3", ".mkv", ".txt", ".wav"]


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    suffix = F.element_at(F.array(*[F.lit(x) for x in PART_SUFFIXES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select("p_partkey", F.concat("p_name", suffix).alias("filename"))


PART_FILES_SQL = ("SELECT p_partkey, p_name || (['" + "', '".join(PART_SUFFIXES)
                  + "'])[CAST(p_partkey % 5 AS INTEGER) + 1] AS filename FROM part")


# --------------------------------------------------------------------------- events with k
def events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events plus ``k`` = integer of ``$.k`` in props."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))


EVENTS_K_SQL = "SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles (x, y, w, h) with w, h >= 1, one per event."""
    e = events_k(spark, sf_dir)
    fv = F.floor("value")
    return e.select("event_id", "user_id", "ts", F.struct(
        (F.col("k") % 50).cast("double").alias("x"), (fv % 40).cast("double").alias("y"),
        (1 + F.col("k") % 17).cast("double").alias("w"), (1 + fv % 13).cast("double").alias("h")).alias("rect"))


RECTS_SQL = """SELECT event_id, user_id, ts,
  CAST(k % 50 AS DOUBLE) AS x, CAST(CAST(floor(value) AS BIGINT) % 40 AS DOUBLE) AS y,
  CAST(1 + k % 17 AS DOUBLE) AS w, CAST(1 + CAST(floor(value) AS BIGINT) % 13 AS DOUBLE) AS h
FROM events_k"""


# --------------------------------------------------------------------------- star schema
# match -> clip -> pair -> files: vm = lineitem, clip = orders, video = customer,
# audio = part, midi = supplier; real = (l_returnflag <> 'R').
URGENT = ["1-URGENT", "2-HIGH"]


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = lambda n: read_table(spark, sf_dir, n)
    li, o = r("lineitem"), r("orders")
    vm = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                   F.col("l_partkey").alias("djv_song_id"),
                   F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("invalid_mode"),
                   F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("real"),
                   F.col("l_orderkey").alias("clip_id"))
    vcc = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"),
                   ((F.col("o_orderkey") % 97) * 5000).alias("start"),
                   ((F.col("o_orderkey") % 97) * 5000 + 15000 + (F.col("o_orderkey") % 13) * 5000).alias("end"),
                   F.lit("mp4").alias("video_type"))
    mam = (li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("index_midi"))
           .select(F.concat(F.lit("M"), F.col("index_midi").cast("string"), F.lit("A"),
                            F.col("l_partkey").cast("string")).alias("pair_id"),
                   "index_midi", F.col("l_partkey").alias("index_audio"), F.col("l_partkey").alias("djv_song_id")))
    ac = r("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("/audio/"), "p_brand").alias("directory"),
                          F.concat("p_name", F.lit(".mp3")).alias("filename"), F.col("p_name").alias("title"))
    mc = r("supplier").select(F.col("s_suppkey").alias("id"),
                              F.concat(F.lit("/midi/"), F.col("s_nationkey").cast("string")).alias("directory"),
                              F.concat("s_name", F.lit(".mid")).alias("filename"))
    vc = r("customer").select(F.col("c_custkey").alias("id"),
                              F.concat(F.lit("/video/"), "c_mktsegment").alias("directory"),
                              F.concat("c_name", F.lit(".mp4")).alias("filename"), F.col("c_name").alias("title"))
    cur = r("labels").select((F.col("doc_id") * 8 + 1 + F.col("doc_id") % 4).alias("audio_video_match_id"),
                             F.col("quality").alias("correct"))
    af = li.groupBy(F.col("l_partkey").alias("audio_id")).agg(
        r6(F.avg("l_quantity")).alias("af_qty_mean"),
        r6(F.stddev_pop("l_extendedprice")).alias("af_price_std"),
        F.max("l_discount").alias("af_disc_max"))
    sfe = li.groupBy(F.col("l_suppkey").alias("midi_id")).agg(
        r6(F.avg("l_quantity")).alias("sf_qty_mean"), r6(F.avg("l_tax")).alias("sf_tax_mean"))
    urgent = o.filter(F.col("o_orderpriority").isin(*URGENT)).select(F.col("o_orderkey").alias("l_orderkey"))
    vf = (li.join(urgent, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("clip_id"))
          .agg(F.count(F.lit(1)).alias("vf_lines"), r6(F.sum("l_extendedprice")).alias("vf_price_sum")))
    songs = mam.join(r("part"), mam["index_audio"] == F.col("p_partkey")).select(
        F.col("djv_song_id").alias("song_id"), F.concat("pair_id", F.lit("_"), "p_name").alias("song_name"))
    return dict(vm=vm, vcc=vcc, mam=mam, ac=ac, mc=mc, vc=vc, cur=cur, af=af, sfe=sfe, vf=vf, songs=songs)


STAR_SQL = dict(
    vm="""SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS djv_song_id,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS invalid_mode,
  CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS real, l_orderkey AS clip_id FROM lineitem""",
    vcc="""SELECT o_orderkey AS id, o_custkey AS video_id, (o_orderkey % 97) * 5000 AS start,
  (o_orderkey % 97) * 5000 + 15000 + (o_orderkey % 13) * 5000 AS "end", 'mp4' AS video_type FROM orders""",
    mam="""SELECT 'M' || min(l_suppkey) || 'A' || l_partkey AS pair_id, min(l_suppkey) AS index_midi,
  l_partkey AS index_audio, l_partkey AS djv_song_id FROM lineitem GROUP BY l_partkey""",
    ac="SELECT p_partkey AS id, '/audio/' || p_brand AS directory, p_name || '.mp3' AS filename, p_name AS title FROM part",
    mc="SELECT s_suppkey AS id, '/midi/' || s_nationkey AS directory, s_name || '.mid' AS filename FROM supplier",
    vc="""SELECT c_custkey AS id, '/video/' || c_mktsegment AS directory, c_name || '.mp4' AS filename,
  c_name AS title FROM customer""",
    cur="SELECT doc_id * 8 + 1 + doc_id % 4 AS audio_video_match_id, quality AS correct FROM labels",
    af="""SELECT l_partkey AS audio_id, floor((avg(l_quantity)) * 1e6 + 0.5) / 1e6 AS af_qty_mean,
  floor((stddev_pop(l_extendedprice)) * 1e6 + 0.5) / 1e6 AS af_price_std, max(l_discount) AS af_disc_max FROM lineitem GROUP BY 1""",
    sfe="""SELECT l_suppkey AS midi_id, floor((avg(l_quantity)) * 1e6 + 0.5) / 1e6 AS sf_qty_mean, floor((avg(l_tax)) * 1e6 + 0.5) / 1e6 AS sf_tax_mean
  FROM lineitem GROUP BY 1""",
    vf="""SELECT l_orderkey AS clip_id, count(*) AS vf_lines, floor((sum(l_extendedprice)) * 1e6 + 0.5) / 1e6 AS vf_price_sum
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
  GROUP BY 1""",
    songs="SELECT m.djv_song_id AS song_id, m.pair_id || '_' || p.p_name AS song_name FROM mam m JOIN part p ON m.index_audio = p.p_partkey",
)
