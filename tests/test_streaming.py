"""Streams equal their batch twins (X1-X5) under Trigger.AvailableNow."""

import os
import random
import shutil

import pytest

from pyspark.sql import functions as F

from reelforge.operators import segments as SEG
from reelforge.operators.chains import accept_with_gap_blocks
from reelforge.plans.adapters import chunks
from reelforge.streaming import stateful as ST
from reelforge.streaming import streams as X

SF = "/root/testdata/sf0.001"


def _run(df, scratch, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", os.path.join(scratch, name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def _events_stream(spark, scratch):
    # File streams read directories: stream a copy of the (small) sf0.001 events table.
    d = os.path.join(scratch, "events_in")
    os.makedirs(d, exist_ok=True)
    shutil.copy(f"{SF}/events.parquet", os.path.join(d, "part-0.parquet"))
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(d)


def test_x2_tumbling_counts(spark, scratch):
    batch = X.chunk_counts(spark.read.parquet(f"{SF}/events.parquet"))
    # complete mode: append mode holds back windows the final watermark has not passed
    got = _run(X.chunk_counts(_events_stream(spark, scratch)), scratch, "x2", mode="complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_x3_sliding_stats(spark, scratch):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn(
        "value", F.when(F.col("event_id") % 5 > 0, F.col("value")))
    late = events.limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 YEARS"))
    src = os.path.join(scratch, "x3in")
    events.unionByName(late).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    kind = dict(size="6 hours", slide="2 hours")
    got = _run(X.sliding_stats(stream, **kind), scratch, "x3")

    def rows(df):
        return sorted((r.user_id, r.start, r.n, *(None if v is None else round(v, 9) for v in (r["mean"], r["std"])))
                      for r in df.collect() if r.user_id >= 0)

    w = F.window("ts", "6 hours", "2 hours").start.alias("start")
    plain = events.groupBy(w, "user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                             F.count(F.lit(1)).alias("n"))
    assert rows(got) == rows(X.sliding_stats(events, **kind)) == rows(plain)


def _batches(spark, folder, schema, batches):
    """A stream of one micro-batch for each list of rows, in this order."""
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        part = os.path.join(folder, f"{i:03d}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part + ".d")
        [one] = [f for f in os.listdir(part + ".d") if f.startswith("part-")]
        shutil.copy(os.path.join(part + ".d", one), part)
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .parquet(os.path.join(folder, "*.parque[t]")))


def _dealt(rows, n, seed):
    """Rows in n batches: those of a span of time shuffled together, some of
    the span before again (replays)."""
    rnd = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // n)
    out = []
    for i in range(n):
        part = rows[i * size:(i + 1) * size] + rnd.sample(rows[max(i - 1, 0) * size:(i + 1) * size], size // 3)
        rnd.shuffle(part)
        out.append(part)
    return out


def test_x4_equals_batch_for_shuffled_late_and_replayed_rows(spark, scratch):
    rnd = random.Random(4)
    rows = [(v, t) for v in range(4) for t in sorted({rnd.randrange(200, 300_000) for _ in range(150)})]
    batches = _dealt(rows, 4, 1)
    far = 10 ** 9
    late = [(0, 5), (1, 100_001), (7, 10)]  # below the watermark of the batches before
    stream = _batches(spark, os.path.join(scratch, "x4in"), "video_id long, ts_ms long",
                      [*batches, [(-1, far)], [(-1, far + 1)], late, [(-1, far + 2)]])
    got = _run(ST.shot_changes(stream, watermark="150 seconds"), scratch, "x4").where("video_id >= 0")
    batch = accept_with_gap_blocks(spark.createDataFrame(rows, "video_id long, ts_ms long"), ["video_id"], "ts_ms", 1100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_x5_equals_batch_for_shuffled_late_and_replayed_rows(spark, scratch):
    rnd = random.Random(5)
    schema = "video_id long, start long, end long, song_id int, offset_seconds double"
    rows = []
    for v in range(5):
        label = None
        for i in range(120):
            if rnd.random() < 0.3:
                label = rnd.choice([None, 1, 2])
            rows.append((v, i * 5000 + 1, i * 5000 + 5001, label, None if rnd.random() < 0.1 else float(rnd.randrange(4))))
    batches = _dealt(rows, 4, 2)
    far = 10 ** 9
    late = [(0, 5, 9, 1, 1.0), (1, 300_001, 300_002, 2, 0.0)]
    stream = _batches(spark, os.path.join(scratch, "x5in"), schema,
                      [*batches, *([(-1, far + i, far + i, 1, 0.0)] for i in range(2)), late, [(-1, far + 2, far + 2, 1, 0.0)]])
    got = _run(ST.segments(stream, watermark="320 seconds", close_after=600_000), scratch, "x5")
    got = got.where("video_id >= 0").select("video_id", "match_id", "song_id", "start", "end", "invalid_mode")
    batch = SEG.segment_timeline(spark.createDataFrame(rows, schema))
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_x5_a_resting_timeline_ends(spark, scratch):
    schema = "video_id long, start long, end long, song_id int, offset_seconds double"

    def rows(begin, label):
        return [(1, begin + i * 5000, begin + i * 5000 + 5000, label, 0.0) for i in range(4)]

    stream = _batches(spark, os.path.join(scratch, "in"), schema,
                      [rows(5000, 7), rows(1_000_000, 7), [(-1, 10 ** 9, 10 ** 9, 1, 0.0)]])
    got = _run(ST.segments(stream, watermark="1 second", close_after=100_000), scratch, "x5rest").where("video_id = 1")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 7, 5000, 25_000, 0), (1, 2, 7, 1_000_000, 1_020_000, 0)]


def test_x1_second_batch_reads_only_its_own_buckets(spark, scratch):
    sink, path = X.append_new_files(os.path.join(scratch, "catalog"), buckets=16), os.path.join(scratch, "catalog")
    first = spark.createDataFrame([(f"d{i % 9}", f"f{i}") for i in range(200)], "directory string, filename string")
    sink(first, 0)
    kept = [os.path.join(path, f"_bucket={b}") for b in range(16)]
    own = spark.createDataFrame([("d0", "f0"), ("new", "g")], "directory string, filename string")
    bucket = F.pmod(F.xxhash64("directory", "filename"), F.lit(16)).cast("int")
    used = {r[0] for r in own.select(bucket).collect()}
    for b, folder in enumerate(kept):  # buckets of other keys can not be read
        if b not in used and os.path.exists(folder):
            for f in os.listdir(folder):
                if f.endswith(".parquet"):
                    with open(os.path.join(folder, f), "wb") as out:
                        out.write(b"no parquet file")
    sink(own, 1)
    got = spark.read.schema("directory string, filename string, _bucket int").parquet(path).where(
        F.col("_bucket").isin(list(used)))
    assert got.where("directory = 'new'").count() == 1 and got.where("directory = 'd0' AND filename = 'f0'").count() == 1


@pytest.mark.parametrize("strategy", ["window", "blocked"])
def test_x5_incremental_segments(spark, scratch, strategy):
    src = os.path.join(scratch, "chunks_in")
    ch = chunks(spark, SF)
    ch.write.parquet(src)
    stream = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(src)
    cp, hist, out = (os.path.join(scratch, n) for n in ("cp5", "hist5", "seg5"))
    q = (stream.writeStream.foreachBatch(X.segment_upsert(hist, out, strategy=strategy)).option("checkpointLocation", cp)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = X.segments(spark, out).select("video_id", "match_id", "song_id", "start", "end", "invalid_mode")
    batch = SEG.segment_timeline(ch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_x5_late_chunks_remove_stale_segments(spark, scratch):
    """Late chunks that break up a segment leave the video without one; a
    replayed batch changes nothing; other videos stay."""
    hist, out = os.path.join(scratch, "hist"), os.path.join(scratch, "seg")
    sink = X.segment_upsert(hist, out, buckets=4)
    schema = "video_id long, start long, end long, song_id int, offset_seconds double"

    def batch(rows):
        return spark.createDataFrame([(v, s * 5000, s * 5000 + 5000, l, float(s)) for v, s, l in rows], schema)

    first = batch([(v, s, 7) for v in range(1, 9) for s in (0, 2, 4, 6)])
    late = batch([(3, s, None) for s in (1, 3, 5)])
    sink(first, 0)
    assert X.segments(spark, out).select("video_id").distinct().count() == 8
    for _ in range(2):
        sink(late, 1)
        got = X.segments(spark, out).select("video_id", "match_id", "song_id", "start", "end", "invalid_mode")
        want = SEG.segment_timeline(first.unionByName(late))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _files(root, names):
    for rel in names:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write("x")


def test_x1_file_catalog_stream(spark, scratch):
    root, sink = os.path.join(scratch, "incoming"), os.path.join(scratch, "catalog")

    def run():
        s = X.file_catalog_stream(spark, root, except_dir=["skip"])
        q = (s.writeStream.foreachBatch(X.append_new_files(sink))
             .option("checkpointLocation", os.path.join(scratch, "cp1")).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted((os.path.basename(r.directory), r.filename) for r in spark.read.parquet(sink).collect())

    _files(root, ["a/one.mid", "b/one.mid", "b/two.mid", "skip/three.mid"])
    want = [("a", "one.mid"), ("b", "one.mid"), ("b", "two.mid")]
    assert run() == want
    # A file with an old modification time is new all the same.
    _files(root, ["a/old.mid"])
    os.utime(os.path.join(root, "a/old.mid"), (10**9, 10**9))
    assert run() == sorted([("a", "old.mid"), *want])
    X.append_new_files(sink)(spark.read.parquet(sink), 7)  # a replayed batch
    assert run() == sorted([("a", "old.mid"), *want])
