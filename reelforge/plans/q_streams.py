"""Queries that run the streams X1-X5 over whole tables with AvailableNow and
return what they wrote; the oracles are batch SQL.

Each run has a folder of its own below the session's checkpoint folder.  A
heartbeat row of a key that does not exist, far in the future, moves the
watermark past all rows, so that every window and timeline is closed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.plans.adapters import EVENT_LABELS, PATHS_SQL, with_ctes
from reelforge.plans.registry import register
from reelforge.session import ensure_checkpoint_dir, table_path
from reelforge.sources.files import catalog_from_paths, prune_catalog
from reelforge.streaming import stateful, streams

HOUR = 3_600_000
FAR = 4_102_444_800_000  # 2100-01-01
HEARTBEAT = -1


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    path = table_path(sf, table)
    # A pattern: a table may be one file, and a stream takes only folders by their plain name.
    pattern = f"{path[:-len('parquet')]}parque[t]"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def _ms(ts: str = "ts") -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({ts} AS timestamp_ntz))")


def _events(spark: SparkSession, sf: str, folder: str, columns: dict) -> DataFrame:
    """Streamed ``user_id``, ``ms`` and more columns of events, and a heartbeat."""
    ev = _stream(spark, sf, "events").select("user_id", _ms().cast("long").alias("ms"),
                                             *[c.alias(n) for n, c in columns.items()])
    beat = spark.range(1).select(F.lit(HEARTBEAT).cast("long").alias("user_id"), F.lit(FAR).cast("long").alias("ms"),
                                 *[F.lit(None).cast(ev.schema[n].dataType).alias(n) for n in columns])
    beat.write.parquet(f"{folder}/heartbeat")
    return ev.unionByName(spark.readStream.schema(ev.schema).parquet(f"{folder}/heartbeat"))


def _finished(df: DataFrame, folder: str) -> DataFrame:
    """Run the stream to its end and read what it appended."""
    out = f"{folder}/out"
    (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return df.sparkSession.read.schema(df.schema).parquet(out)


# ---- X1 ----------------------------------------------------------------------------------
@register("x01_new_file_stream", with_ctes("""SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory,
  regexp_extract(path, '([^/]*)$', 1) AS filename
FROM paths WHERE NOT regexp_matches(regexp_extract(path, '([^/]*)$', 1), '7')""", paths=PATHS_SQL))
def x01_new_file_stream(spark, sf):
    """New files of the page paths, stored once each."""
    folder = _folder(spark, "x01")
    u = F.col("url")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z]+://", ""), r"[?#].*$", ""), r"/+$", "")
    files = prune_catalog(catalog_from_paths(_stream(spark, sf, "pages").select(path.alias("path")), "path"), (), "7")
    (files.select("directory", "filename").writeStream.foreachBatch(streams.append_new_files(f"{folder}/catalog"))
     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("directory string, filename string").parquet(f"{folder}/catalog").drop("_bucket")


# ---- X2 / X3 -------------------------------------------------------------------------------
@register("x02_chunk_counts_stream", f"""SELECT user_id, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS start_ms,
  (epoch_us(ts) // 1000) // {HOUR} * {HOUR} + {HOUR} AS end_ms, count(*) AS n
FROM events GROUP BY 1, 2, 3""")
def x02_chunk_counts_stream(spark, sf):
    folder = _folder(spark, "x02")
    ev = _events(spark, sf, folder, {}).withColumn("t", F.timestamp_millis("ms"))
    counts = streams.chunk_counts(ev, "user_id", "t", "1 hour", "10 seconds")
    return _finished(counts.select("user_id", F.unix_millis("start").alias("start_ms"),
                                   F.unix_millis("end").alias("end_ms"), "n"), folder)


@register("x03_sliding_stats_stream", f"""SELECT user_id, w AS start_ms, count(*) AS n,
  floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean, floor(stddev_pop(value) * 1e6 + 0.5) / 1e6 AS std
FROM (SELECT user_id, value, unnest([(epoch_us(ts) // 1000) // {HOUR} * {HOUR} - k * {HOUR} FOR k IN range(6)]) AS w FROM events)
GROUP BY 1, 2""")
def x03_sliding_stats_stream(spark, sf):
    folder = _folder(spark, "x03")
    ev = _events(spark, sf, folder, {"value": F.col("value")}).withColumn("t", F.timestamp_millis("ms"))
    stats = streams.sliding_stats(ev, "value", "user_id", "t", "6 hours", "1 hour", "10 seconds")
    done = _finished(stats.select("user_id", F.unix_millis("start").alias("start_ms"), "n", "mean", "std"), folder)
    return done.select("user_id", "start_ms", "n", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("mean", "std")])


# ---- X4 ------------------------------------------------------------------------------------
_GAP = 6 * HOUR


@register("x04_shot_changes_stream", f"""WITH RECURSIVE
cand AS (SELECT DISTINCT user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type <> 'view'),
acc(user_id, ms) AS (
  SELECT user_id, min(ms) FROM cand WHERE ms > {_GAP} GROUP BY user_id
  UNION ALL
  SELECT c.user_id, min(c.ms) FROM acc a JOIN cand c ON c.user_id = a.user_id AND c.ms > a.ms + {_GAP} GROUP BY c.user_id)
SELECT user_id, ms FROM acc""")
def x04_shot_changes_stream(spark, sf):
    folder = _folder(spark, "x04")
    ev = _events(spark, sf, folder, {"event_type": F.col("event_type")})
    cand = ev.where("event_type IS NULL OR event_type <> 'view'")
    return _finished(stateful.shot_changes(cand, ["user_id"], "ms", _GAP), folder).where(F.col("user_id") >= 0)


# ---- X5 ------------------------------------------------------------------------------------
_LABEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_LABELS.items()) + " END"


def _segment_sql() -> str:
    from reelforge.plans import q_segments as S
    chunks = f"""SELECT user_id AS video_id, (epoch_us(ts) // 1000) AS start, (epoch_us(ts) // 1000) + 5000 AS "end", CAST({_LABEL_SQL} AS BIGINT) AS song_id,
  CASE WHEN {_LABEL_SQL} IS NOT NULL THEN CAST(floor(value / 50) AS DOUBLE) END AS offset_seconds FROM events"""
    return with_ctes("""SELECT r.video_id, r.match_id, r.song_id, min(r.start) AS start, max(r."end") AS "end",
  CAST(max(m.invalid_mode) AS INTEGER) AS invalid_mode
FROM segrows r JOIN modes m USING (video_id, match_id) JOIN sizes s USING (video_id, match_id)
WHERE s.too_small = 0 GROUP BY 1, 2, 3""", **(S._BASE | {"chunks": chunks}), segrows=S._SEGROWS, modes=S._MODES,
                     sizes=S._SIZES)


@register("x05_segments_stream", _segment_sql())
def x05_segments_stream(spark, sf):
    folder = _folder(spark, "x05")
    label = None
    for name, code in EVENT_LABELS.items():
        hit = F.col("event_type") == name
        label = F.when(hit, F.lit(code)) if label is None else label.when(hit, F.lit(code))
    ev = _events(spark, sf, folder, {
        "song_id": label.cast("long"),
        "offset_seconds": F.when(label.isNotNull(), F.floor(F.col("value") / 50).cast("double"))})
    chunks = ev.select(F.col("user_id").alias("video_id"), F.col("ms").alias("start"),
                       (F.col("ms") + 5000).alias("end"), "song_id", "offset_seconds")
    return _finished(stateful.segments(chunks, close_after=400 * 24 * HOUR), folder).where(F.col("video_id") >= 0)
