"""Star joins, work lists, incremental control and quality checks.

The star joins are written as DataFrame joins on keys; Catalyst turns the
``clip_id IS NOT NULL`` filter on a left-joined side into an inner join
(EliminateOuterJoin) and the planner picks broadcast for dimension tables
only when their measured size is under the threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reelforge.functions import text as T
from reelforge.session import ensure_checkpoint_dir


def curated_or_fake(vm: DataFrame, cur: DataFrame) -> DataFrame:
    """``correct = 1 OR real = 0`` after a left join to the curation
    (three-valued: an uncurated real match is dropped)."""
    j = vm.join(cur, vm["id"] == cur["audio_video_match_id"], "left")
    return j.filter((F.col("correct") == 1) | (F.col("real") == 0))


def examples(t: dict, keep: Column) -> DataFrame:
    """The matches that ``keep`` accepts (a condition on ``real`` and
    ``correct``) with their clip and their pair.

    Curation decides first: it is one row per match and removes most matches
    before anything wide is joined.  Then the match finds its clip, and its
    song's pair of catalog rows."""
    curated = t["cur"].select(F.col("audio_video_match_id").alias("id"), "correct")
    clip = t["vcc"].select(F.col("id").alias("clip_id"), "video_id", "start", "end", "video_type")
    pair = t["mam"].select("djv_song_id", F.col("index_audio").alias("audio_id"), F.col("index_midi").alias("midi_id"))
    found = t["vm"].join(curated, "id", "left").where(keep)
    return (found.select("id", "djv_song_id", "real", F.col("clip_id").alias("_clip"))
            .join(clip, F.col("_clip") == F.col("clip_id"), "left").drop("_clip")
            .join(pair, "djv_song_id", "left"))


def usable() -> Column:
    """F6 as a condition: curated as correct, or a made-up negative."""
    return (F.col("correct") == 1) | (F.col("real") == 0)


def _file(files: DataFrame, key: str, prefix: str, kind: bool = True) -> DataFrame:
    """A catalog as (key, <prefix>_type, <prefix>_file_path)."""
    path = T.path_join(F.col("directory"), F.col("filename")).alias(f"{prefix}_file_path")
    types = [T.type_suffix(F.col("filename")).alias(f"{prefix}_type")] if kind else []
    return files.select(F.col("id").alias(key), *types, path)


def extraction_dirs(t: dict) -> DataFrame:
    """Every usable match with the files of its three modalities."""
    out = (examples(t, usable()).join(_file(t["ac"], "audio_id", "audio"), "audio_id", "left")
           .join(_file(t["mc"], "midi_id", "midi"), "midi_id", "left")
           .join(_file(t["vc"], "video_id", "video", kind=False), "video_id", "left"))
    # An id whose catalog row is missing stays as the pair names it.
    return out.select("id", "clip_id", "audio_id", "midi_id", "video_id", "start", "end", "video_type", "audio_type",
                      "midi_type", "audio_file_path", "midi_file_path", "video_file_path", "real", "djv_song_id")


def correct_videos(t: dict) -> DataFrame:
    """Curated-correct clips with their song and video file."""
    song = t["songs"].select(F.col("song_id").alias("djv_song_id"), "song_name")
    video = t["vc"].select(F.col("id").alias("video_id"), "title", "directory", "filename")
    curated = t["cur"].where("correct = 1").select(F.col("audio_video_match_id").alias("id"))
    clip = t["vcc"].select(F.col("id").alias("clip_id"), "video_id", "start", "end", "video_type")
    return (t["vm"].join(curated, "id").select(F.col("clip_id"), "djv_song_id")
            .join(clip, "clip_id", "left").join(song, "djv_song_id", "left").join(video, "video_id", "left")
            .select(F.when(F.col("video_id").isNotNull() | F.col("start").isNotNull(), F.col("clip_id")).alias("id"),
                    "start", "end", "video_type", "song_name", "title", "directory", "filename"))


def feature_join(t: dict) -> DataFrame:
    """The three feature tables side by side for every match, usable or
    not, null where a modality has no features."""
    wide = examples(t, F.lit(True))
    for name, key in (("af", "audio_id"), ("sfe", "midi_id"), ("vf", "clip_id")):
        own = t[name]
        wide = wide.join(own.withColumnRenamed(key, f"_{key}"), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    values = [c for n in ("af", "sfe", "vf") for c in t[n].columns if c not in ("audio_id", "midi_id", "clip_id")]
    return wide.select("id", "real", *values)


def training_table(t: dict) -> DataFrame:
    """J12 + F6 + F7 = Q8: labelled training table ``y = real``: usable matches
    whose clip has video features, with the audio and symbolic ones beside."""
    wide = examples(t, usable()).select("id", "video_id", F.col("real").alias("y"), "clip_id", "audio_id", "midi_id")
    audio = t["af"].withColumn("_audio", F.col("audio_id"))
    notes = t["sfe"].withColumn("_midi", F.col("midi_id"))
    wide = wide.withColumnsRenamed({"audio_id": "_audio", "midi_id": "_midi"})
    out = wide.join(t["vf"], "clip_id").join(audio, "_audio", "left").join(notes, "_midi", "left")
    return out.select("id", "video_id", "y", *t["af"].columns, *t["sfe"].columns, *t["vf"].columns)


def work_list(dirs: DataFrame, done: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Q1: ids still to process: project, drop null ids (N13), anti-join the
    ids already done, distinct."""
    todo = dirs.select(id_col, *cols).filter(F.col(id_col).isNotNull())
    return todo.join(done.select(id_col).distinct(), id_col, "left_anti").distinct()


def mark_processed(df: DataFrame, processed: DataFrame, key: str, flag: str = "searched") -> DataFrame:
    """Q2: ``UPDATE t SET flag = 1 WHERE key IN processed`` as a set-based
    rewrite (left join on the distinct processed keys)."""
    p = processed.select(F.col(key).alias("_p")).distinct()
    j = df.join(p, df[key] == p["_p"], "left")
    return j.withColumn(flag, F.when(F.col("_p").isNotNull(), F.lit(1)).otherwise(F.col(flag))).drop("_p")


def quarantine(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Q3 + N14: split keys into (valid, rejected): one NaN / Inf / null value
    voids the whole vector of its key.  One grouped aggregate, no collect."""
    bad = F.isnull(F.col(value)) | F.isnan(F.col(value)) | (F.abs(F.col(value)) == F.lit(float("inf")))
    flags = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"),
                                F.count(F.when(bad, 1)).alias("n_bad"))
    return flags.filter(F.col("n_bad") == 0), flags.filter(F.col("n_bad") > 0)


def load_curation(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Q4 + N12: map the CSV header (``id``, ``Correct``) to the table's names."""
    return raw.withColumnsRenamed(mapping or {"id": "audio_video_match_id", "Correct": "correct"})


def unique_violations(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Q5: keys occurring more than once (empty = the PK / UNIQUE holds)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Q6: child rows whose non-null key has no parent (empty = FK holds)."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(p, child_key, "left_anti")


#: Rows that one range of ids has on average.
RANGE_ROWS = 1 << 20


def assign_ids(df: DataFrame, order: Sequence[str], start: Column | int = 1, out: str = "id",
               range_rows: int = RANGE_ROWS) -> DataFrame:
    """Dense ids ``start, start+1, ...`` in a deterministic order
    (any sortable column types) without a single-partition window.

    The table is cut into ranges of about ``range_rows`` rows, as many as its
    row count asks for, sorted and numbered inside each range and written once
    below the session's checkpoint folder: the cuts are sampled, so they must
    not be drawn again for the counts.  A row's id adds the rows of the ranges
    before its own, from one count per range.  Equal keys go by a hash of the
    whole row, so a key that very many rows share is cut, too, and ids are the
    same in every run (but for equal rows)."""
    spark = df.sparkSession
    rows = df.count()
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not f.dataType.simpleString().count("map<")])
    keyed = df.withColumn("_tie", tie)
    by = [*[F.col(c) for c in order], F.col("_tie")]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    (keyed.repartitionByRange(max(1, -(-rows // range_rows)), *by).sortWithinPartitions(*by)
     .withColumn("_at", F.monotonically_increasing_id()).drop("_tie").write.parquet(path))
    numbered = (spark.read.schema(StructType([*df.schema.fields, StructField("_at", LongType())])).parquet(path)
                .withColumn("_range", F.shiftright("_at", 33)))
    counts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    s = F.lit(start) if isinstance(start, int) else start
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (numbered.join(before, "_range").withColumn(out, (F.col("_off") + place + s).cast("long"))
            .select(*df.columns, out))


def set_equality(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Are the two key sets equal?  One full outer join of the distinct
    keys, counted on both sides."""
    ka = a.select(key).distinct().withColumn("_a", F.lit(1))
    kb = b.select(key).distinct().withColumn("_b", F.lit(1))
    j = ka.join(kb, key, "full")
    return (j.agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("only_left"),
                  F.count(F.when(F.col("_a").isNull(), 1)).alias("only_right"))
            .withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0)))


def append_negatives(matches: DataFrame, negatives: DataFrame, order: Sequence[str]) -> DataFrame:
    """Negatives get fresh ids after the current max id (Q7) and are
    appended under the positives with ``unionByName``."""
    max_id = matches.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m")).withColumn("_one", F.lit(1))
    neg = negatives.withColumn("_one", F.lit(1)).join(F.broadcast(max_id), "_one").drop("_one")
    neg = assign_ids(neg, order, start=F.col("_m") + 1).drop("_m")
    return matches.unionByName(neg, allowMissingColumns=True)


def store_segments(segments: DataFrame, keys: Sequence[str] = ("video_id",), video_type: Column | None = None,
                   existing_clips: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """N9 (the intent of the segment finder's tail): distinct clips of the
    kept segments not stored yet (J4) get surrogate ids after the current
    maximum (Q7); matches are joined back to their clip on (video, start)
    (J9) with ``real = 1``.  Returns (new_clips, new_matches).

    The segments are written once below the session's checkpoint folder: the
    clips' count, the cuts of their ids, the ids and the matches read them from
    there, and none runs the recognition behind them again."""
    k = list(keys)
    path = f"{ensure_checkpoint_dir(segments.sparkSession).rstrip('/')}/segments-{uuid.uuid4().hex}"
    segments.write.parquet(path)
    segments = segments.sparkSession.read.schema(segments.schema).parquet(path)
    vt = video_type if video_type is not None else F.lit("mp4")
    clips = segments.select(*k, "start", "end", vt.alias("video_type")).distinct()
    if existing_clips is not None:
        clips = clips.join(existing_clips.select(*k, "start"), [*k, "start"], "left_anti")
        start = existing_clips.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_m")).withColumn("_one", F.lit(1))
        clips = clips.withColumn("_one", F.lit(1)).join(F.broadcast(start), "_one").drop("_one")
        first = F.col("_m") + 1
    else:
        first = F.lit(1)
    clips = assign_ids(clips.withColumn("_first", first), [*k, "start"], start=F.col("_first")).drop("_first", "_m")
    matches = (segments.join(clips.select(F.col("id").alias("clip_id"), *k, "start"), [*k, "start"])
               .select(F.col("song_id").alias("djv_song_id"), "invalid_mode", F.lit(1).alias("real"), "clip_id"))
    return clips, matches
