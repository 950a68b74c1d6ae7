"""Golden cases G1-G7 (FIXTURES.md section 3) on hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from reelforge.functions import scalar as X
from reelforge.functions import text as T
from reelforge.operators import frames as FR
from reelforge.operators import segments as SEG
from reelforge.operators.chains import accept_with_gap_blocks


def _chunks(spark, ids, offs, video=1):
    rows = [(video, 5000 * i, 5000 * (i + 1), s, None if o is None else float(o))
            for i, (s, o) in enumerate(zip(ids, offs))]
    return spark.createDataFrame(rows, "video_id long, start long, end long, song_id int, offset_seconds double")


G1_IDS = [None, 7, 7, None, 7, 7, 3, 3, 9, None, 5, 5, 5, None]
G1_OFF = [None, 10, 15, None, 25, 30, 1, 6, 2, None, 4, 9, 20, None]


def test_g1_rows(spark):
    rows = SEG.tag_chunks(_chunks(spark, G1_IDS, G1_OFF)).orderBy("start").collect()
    assert [r.song_id for r in rows] == [None, 7, 7, 7, 7, 7, 3, 3, 9, None, 5, 5, 5, None]
    assert [r.offset_seconds for r in rows][3] == 5.0
    assert "".join(r.match_tag for r in rows) == "OBIIIEBEOOBIEO"
    assert [r.offset_diff for r in rows] == [None, None, 5, -10, 20, 5, None, 5, None, None, None, 5, 11, None]
    assert [r.match_id for r in rows] == [None, 1, 1, 1, 1, 1, 2, 2, None, None, 3, 3, 3, None]


def test_g1_segments(spark):
    out = SEG.segment_timeline(_chunks(spark, G1_IDS, G1_OFF)).orderBy("match_id").collect()
    assert [(r.match_id, r.song_id, r.start, r.end, r.invalid_mode) for r in out] == [
        (1, 7, 5000, 30000, 0), (3, 5, 50000, 65000, 1)]


def test_g2_segments(spark):
    ids = [None, 7, 7, 7, 7, 3, 3, 9, 9, 9, None]
    offs = [None, 10, 15, 20, 25, 1, 6, 2, 7, 30, None]
    rows = SEG.tag_chunks(_chunks(spark, ids, offs)).orderBy("start").collect()
    assert "".join(r.match_tag for r in rows) == "OBIIEBEBIEO"
    out = SEG.segment_timeline(_chunks(spark, ids, offs)).orderBy("match_id").collect()
    assert [(r.match_id, r.song_id, r.start, r.end, r.invalid_mode) for r in out] == [
        (1, 7, 5000, 25000, 0), (3, 9, 35000, 50000, 1)]


def test_all_null_video_has_no_segments(spark):
    assert SEG.segment_timeline(_chunks(spark, [None] * 6, [None] * 6)).count() == 0


def greedy_scan(times, gap):
    """W11's rule, one candidate after the other."""
    last, kept = 0, []
    for t in sorted(times):
        if t - last > gap:
            kept.append(t)
            last = t
    return kept


def test_g3_greedy_gap(spark):
    times = [400, 1000, 1200, 2000, 2400, 3400, 3600]
    c = spark.createDataFrame([(1, t) for t in times], "video_id long, ts_ms long")
    acc = sorted(r.ts_ms for r in accept_with_gap_blocks(c, ["video_id"], "ts_ms", 1100).collect())
    assert acc == greedy_scan(times, 1100) == [1200, 2400, 3600]


def test_g4_column_stats(spark):
    vals = list(range(1, 20)) + [40]
    df = spark.createDataFrame([(1, float(v)) for v in vals], "g long, value double")
    r = FR.column_stats(df, ["g"]).collect()[0]
    assert r.mean == pytest.approx(11.5)
    assert r.std == pytest.approx(8.440971508, abs=1e-6)
    assert r.stdmean == pytest.approx(0.803894392, abs=1e-6)
    assert r.mean_top10 == pytest.approx(29.5)


def test_g4_top10_uses_all_rows_below_ten(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [1, 2, 3]], "g long, value double")
    assert FR.column_stats(df, ["g"]).collect()[0].mean_top10 == pytest.approx(2.0)


def test_g5_histogram(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [0, 30, 31, 222, 223, 255]], "g long, v double")
    rows = FR.histogram(df, ["g"], "v", -1, 32, 8).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 1, 0, 0, 0, 0, 1, 2]
    assert sum(r.share for r in rows) == pytest.approx(1.0)


@pytest.mark.parametrize("raw,with_num,without", [
    ("The_DoorsLightMyFire(karaoke)v2", "the doors light my fire", "the doors light my fire v"),
    ("02-ABBAGold.Mix", "02 abba gold", "abba gold"),
    ("x264.1080p", "", "x p"),
])
def test_g6_title_cleaner(spark, raw, with_num, without):
    df = spark.createDataFrame([(raw,)], "t string")
    r = df.select(T.clean_title("t", True).alias("a"), T.clean_title("t", False).alias("b")).collect()[0]
    assert (r.a, r.b) == (with_num, without)


def test_camel_split(spark):
    df = spark.createDataFrame([("fooBarHTMLParser",)], "t string")
    assert df.select(T.split_camel("t")).collect()[0][0] == "foo Bar HTML Parser"


def test_g7_super_categories(spark):
    df = spark.createDataFrame([(x,) for x in [1, 9, 14, 24, 29, 39, 46, 56, 62, 68, 73, 80, 2, 10]], "l int")
    got = [r[0] for r in df.select(X.super_category("l")).collect()]
    assert got == list(range(1, 13)) + [2, 3]


def test_file_titles_drop_unmatched(spark):
    df = spark.createDataFrame([("melody.mid",), ("a.mid.bak",), ("x.MP3",), ("1080p.mid",), ("song.mid",)], "filename string")
    out = {r.filename: (r.title, r.file_type) for r in T.cleanup_file_titles(df, "midi", True).collect()}
    assert out == {"melody.mid": ("melody", "mid"), "a.mid.bak": ("a", "mid")}  # "song" is a stopword
    with pytest.raises(ValueError):
        T.cleanup_file_titles(df, "photo")


def test_prefix_before_underscore(spark):
    df = spark.createDataFrame([("M1A2_song",), ("nounderscore",)], "s string")
    assert [r[0] for r in df.select(T.prefix_before("s")).collect()] == ["M1A2", ""]


@pytest.mark.parametrize("span, fan, levels", [(1500, 2, 3), (5000, 3, 1), (1101, 2, 2), (None, 64, 2)])
def test_greedy_gap_blocks_equal_a_scan_on_a_hot_video(spark, span, fan, levels):
    rnd = random.Random(span)
    times = {v: sorted({rnd.randrange(-500, 90_000 if v else 900_000) for _ in range(40 if v else 3000)}) for v in range(5)}
    times[9] = [5000]
    times[10] = [1100, 1100, 1101]
    rows = [(v, t) for v, ts in times.items() for t in ts] + [(1, None), (None, 4000), (None, 4500)]
    rnd.shuffle(rows)
    c = spark.createDataFrame(rows, "video_id long, ts_ms long")
    got = accept_with_gap_blocks(c, ["video_id"], "ts_ms", 1100, span, fan, levels).collect()
    want = [(v, t) for v, ts in [*times.items(), (None, [4000, 4500])] for t in greedy_scan(ts, 1100)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 100


def test_greedy_gap_runs_no_job_while_it_is_planned(spark):
    tracker = spark.sparkContext.statusTracker()
    c = spark.range(100).select(F.lit(1).alias("video_id"), (F.col("id") * 700).alias("ts_ms"))
    spark.sparkContext.setJobGroup("planned", "w11")
    accept_with_gap_blocks(c, ["video_id"], "ts_ms", 1100)
    assert list(tracker.getJobIdsForGroup("planned")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
