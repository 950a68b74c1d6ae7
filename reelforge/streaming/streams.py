"""Structured Streaming versions of the batch operators (X1-X3, and X5 as a
table that is kept up to date); X4 and X5 with state are in ``stateful``.

Each builder returns a streaming DataFrame (or starts a query for the
``foreachBatch`` ones) and is checked against its batch twin with
``Trigger.AvailableNow`` in the tests.  Checkpoint locations are always the
caller's (a shared folder on a cluster); nothing is written locally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.operators import segments as SEG
from reelforge.sources.files import catalog_from_paths, prune_catalog


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: A file is new when it was not listed before, however old it is.
MAX_FILE_AGE = "36500d"


# ---- X1: new-file catalog --------------------------------------------------------------
def file_catalog_stream(spark: SparkSession, root: str, except_dir: Sequence[str] = (),
                        except_file: str = "") -> DataFrame:
    """Streaming catalog of new files under ``root`` (path only; file
    bodies are never read).  The source lists each file once, whatever its
    modification time; a file is its directory and name."""
    s = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
         .option("recursiveFileLookup", "true").option("maxFileAge", MAX_FILE_AGE).load(root)
         .select(F.regexp_replace("path", "^file:", "").alias("path")))
    return prune_catalog(catalog_from_paths(s, "path"), except_dir, except_file).select("directory", "filename")


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table at ``path``, or None if nothing was written there yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else None


def append_new_files(catalog_path: str, buckets: int = 256):
    """X1 sink for ``foreachBatch``: append only files (directory and name)
    not stored yet (J4 anti-join), so a replayed batch appends nothing twice.
    The catalog is partitioned by a hash of the key; a batch reads the buckets
    of its own keys and no others."""
    key = ["directory", "filename"]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def sink(batch: DataFrame, epoch_id: int) -> None:
        new = batch.select(*key).dropDuplicates(key).withColumn("_bucket", bucket)
        existing = _stored(batch.sparkSession, catalog_path, new.schema)
        if existing is not None:
            used = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
            known = existing.where(F.col("_bucket").isin(used))
            new = new.join(known.select(*key, "_bucket"), [*key, "_bucket"], "left_anti")
        new.select(*key, "_bucket").write.mode("append").partitionBy("_bucket").parquet(catalog_path)
    return sink


# ---- X2 / X3: event-time windows -----------------------------------------------------------
def chunk_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", chunk: str = "5 seconds",
                 watermark: str = "10 seconds") -> DataFrame:
    """Tumbling ``chunk`` counts per key; rows later than the watermark
    are dropped (works on batch DataFrames too, where nothing is late)."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_t", watermark)
    return (e.groupBy(F.window("_t", chunk).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def sliding_stats(events: DataFrame, value: str = "value", key: str = "user_id", ts: str = "ts",
                  size: str = "2 seconds", slide: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """Sliding-window mean and population std (the streaming W16).

    ``size`` is a multiple of ``slide``: rows are first reduced to one row of
    moments per pane of ``slide``, and windows merge the few panes they cover,
    so rows are not copied into every window.  ``n`` counts all rows, mean and
    std leave null values out."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_t", watermark)
    panes = (e.groupBy(F.window("_t", slide).alias("p"), key)
             .agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("c"), F.avg(value).alias("m"),
                  F.var_pop(value).alias("v"))
             .withColumn("_p", F.window_time("p")))
    found = (panes.groupBy(F.window("_p", size, slide).alias("w"), key)
             .agg(F.sum("n").alias("n"), F.collect_list(F.struct("c", "m", "v")).alias("panes")))
    return found.select(key, F.col("w.start").alias("start"), *merged_moments("panes"), "n")


def merged_moments(panes: str) -> tuple:
    """Mean and population std over panes of (count ``c``, mean ``m``, variance ``v``)."""
    some = F.filter(panes, lambda p: p["c"] > 0)
    n = F.aggregate(some, F.lit(0).cast("long"), lambda acc, p: acc + p["c"])
    mean = F.aggregate(some, F.lit(0.0), lambda acc, p: acc + p["c"] * p["m"]) / F.nullif(n, F.lit(0))
    squares = F.aggregate(some, F.lit(0.0), lambda acc, p: acc + p["c"] * (p["v"] + (p["m"] - mean) * (p["m"] - mean)))
    return mean.alias("mean"), F.sqrt(squares / F.nullif(n, F.lit(0))).alias("std")


# ---- X5: exact incremental segmentation ------------------------------------------------------
def segment_upsert(chunks_path: str, segments_path: str, keys: Sequence[str] = ("video_id",), min_chunks: int = 3,
                   strategy: str = "blocked", buckets: int = 64):
    """X5 sink for ``foreachBatch``: store the new chunks, then recompute the
    W8 segments of exactly the videos touched by the batch and replace theirs,
    so the streamed result always equals the batch result, also when late
    chunks leave a video without segments, and a replayed batch changes nothing.

    Both tables are partitioned by ``_bucket`` (a hash of the key), so a batch
    reads and rewrites the buckets it touches: their untouched rows and the
    new segments.  A bucket that ends up empty is written as one row without
    a segment, which readers (``segments``) leave out."""
    k = list(keys)
    bucket = F.pmod(F.xxhash64(*k), F.lit(buckets)).cast("int")

    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("_bucket", bucket).write.mode("append").partitionBy("_bucket").parquet(chunks_path)
        touched = batch.select(*k, bucket.alias("_bucket")).distinct()
        used = [r["_bucket"] for r in touched.select("_bucket").distinct().collect()]  # at most ``buckets``
        if not used:
            return
        hist = (spark.read.parquet(chunks_path).where(F.col("_bucket").isin(used)).drop("_bucket")
                .join(touched.select(*k), k, "left_semi").dropDuplicates([*k, "start"]))
        seg = SEG.segment_timeline(hist, k, ["start"], min_chunks=min_chunks, strategy=strategy)
        new = seg.withColumn("_bucket", bucket)
        old = _stored(spark, segments_path, new.schema)
        if old is not None:
            new = new.unionByName(old.where(F.col("_bucket").isin(used) & F.col("match_id").isNotNull())
                                  .join(touched.select(*k), k, "left_anti"))
        marks = touched.select("_bucket").distinct().select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields if f.name != "_bucket"], "_bucket")
        # The rows come partly from the folder that is overwritten: write them aside first.
        aside = f"{segments_path.rstrip('/')}__batch"
        new.unionByName(marks).write.mode("overwrite").parquet(aside)
        (spark.read.schema(new.schema).parquet(aside).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(segments_path))
    return sink


def segments(spark: SparkSession, segments_path: str) -> DataFrame:
    """The segments stored by :func:`segment_upsert`."""
    return spark.read.parquet(segments_path).where(F.col("match_id").isNotNull()).drop("_bucket")
