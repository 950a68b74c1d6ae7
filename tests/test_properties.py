"""Properties of the operators on the sf0.001 tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from reelforge.operators import frames as FR
from reelforge.operators import matching as M
from reelforge.plans.adapters import chunks

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["video_id", "match_id", "song_id", "start", "end", "invalid_mode"]
    assert df.count() > 0


def test_segments_do_not_overlap_and_are_long_enough(spark):
    seg = E.queries()["w08_segmentation"](spark, SF)
    w = Window.partitionBy("video_id").orderBy("start")
    bad = seg.withColumn("prev_end", F.lag("end").over(w)).filter(F.col("prev_end") > F.col("start"))
    assert bad.count() == 0
    assert seg.filter((F.col("end") - F.col("start")) < 3 * 5000).count() == 0


def test_histogram_shares_sum_to_one(spark):
    h = E.queries()["a06_rgb_histogram"](spark, SF)
    sums = h.groupBy("video_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-5 for r in sums)


def test_first_match_one_row_per_key(spark):
    m = E.queries()["j06_catalog_match_first"](spark, SF)
    assert m.count() == m.select("spotify_URL").distinct().count()


def test_append_new_is_idempotent(spark):
    new = chunks(spark, SF).select("video_id", "start")
    first = M.append_new(new, new.limit(0), ["video_id", "start"])
    assert first.count() == new.count()
    assert M.append_new(new, first, ["video_id", "start"]).count() == 0


def test_column_stats_ignore_row_order(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), F.sqrt("id").alias("value"))
    a = {tuple(r) for r in FR.column_stats(df, ["g"]).collect()}
    b = {tuple(r) for r in FR.column_stats(df.orderBy(F.rand(7)).repartition(5), ["g"]).collect()}
    assert a == b


def test_surrogate_ids_dense_and_unique(spark):
    ids = E.queries()["q07_surrogate_ids"](spark, SF)
    n = ids.count()
    r = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.countDistinct("id").alias("d")).collect()[0]
    assert r.d == n and r.hi - r.lo + 1 == n


def test_w8_single_exchange(spark):
    """With the window strategy every window and aggregate of W8 shares one hash exchange."""
    from reelforge.operators import segments as SEG
    ch = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("start"), F.col("event_id").alias("end"),
        (F.col("event_id") % 3).alias("song_id"), F.col("value").alias("offset_seconds"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = SEG.segment_timeline(ch)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_blocked_segmentation_equals_window_on_a_hot_timeline(spark):
    """One timeline holding every chunk (a hot key): the skew-safe plan, with
    tiny spans and blocks, equals the per-key window plan."""
    from reelforge.operators import segments as SEG
    ch = chunks(spark, SF)
    hot = ch.select(F.lit(0).cast("long").alias("video_id"),
                    (F.col("video_id") * 10_000_000 + F.col("start")).alias("start"),
                    (F.col("video_id") * 10_000_000 + F.col("end")).alias("end"), "song_id", "offset_seconds")
    both = ch.unionByName(hot.withColumn("video_id", F.lit(-1).cast("long")))
    a = SEG.segment_timeline(both, strategy="window").collect()
    b = SEG.segment_timeline(both, strategy="blocked", span=5000 * 8, block_rows=16).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) > 0


def test_ranked_values_with_a_dominant_value(spark):
    from reelforge.operators.sequence import ranked_values
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("g"),
                                  F.when(F.col("id") % 3 > 0, 5.0).otherwise((F.col("id") * 7919 % 1013).cast("double")).alias("v"))
    got = {(x.g, x.v): (x._c, x._before, x._n) for x in ranked_values(df, ["g"], "v", cell_values=8).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.g, []).append(r.v)
    assert got == {(g, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for g, vs in by.items() for v in set(vs)}


def test_patterns_that_begin_alike_meet_the_texts_of_their_rarest_gram(spark):
    import re
    rnd = random.Random(8)
    letters = "abcdefgh "
    tails = ["".join(rnd.choice(letters[:8]) for _ in range(rnd.randrange(2, 7))) for _ in range(60)]
    patterns = [f"the {t}" for t in tails] + ["the", "a", "zz", "no such film", "", None]
    texts = [(i, f"the {rnd.choice(tails)} and the {''.join(rnd.choice(letters) for _ in range(30))}"
              + rnd.choice([" soundtrack", " film", "", " soundtrack the end"])) for i in range(400)] + [(7, "the film"), (None, None)]
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    t = spark.createDataFrame(texts, "i int, t string")
    got = {r.p: r.i for r in M.first_pattern_match(p, t, "p", "t", "i").collect()}
    want = {}
    for x in patterns:
        hit = [i for i, s in texts if x and s and re.search(f".*({x}).*(soundtrack|film)", s)]
        if hit:
            want[x] = min(hit)
    assert got == want and len(want) > 40


def test_an_outlier_and_an_infinity_leave_the_cells_small(spark):
    """Cells are cut at the values themselves: extreme ones move no other cut."""
    from reelforge.operators.sequence import ranked_values
    values = [i / 7 for i in range(4000)] + [1e12, float("inf"), float("-inf")]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 0.5)], "g int, v double")
    ranks = ranked_values(df, ["g"], "v", cell_values=100)
    got = {(r.g, r.v): r._before for r in ranks.collect()}
    assert got == {**{(1, v): sorted(values).index(v) for v in values}, (2, 0.5): 0}
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in plan
    text = ranks._jdf.queryExecution().analyzed().toString()
    assert "max(v" not in text and "min(v" not in text  # no cut follows the range


@pytest.mark.parametrize("range_rows", [1 << 20, 50, 7])
def test_dense_ids_follow_the_order_whatever_the_ranges(spark, range_rows):
    from reelforge.operators.training import assign_ids
    rows = [(i % 5 if i % 3 else None, "same" if i < 400 else f"k{i * 7919 % 1000}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(9)
    ids = assign_ids(df, ["a", "b"], start=11, range_rows=range_rows).collect()
    assert sorted(r.id for r in ids) == list(range(11, 911))
    keys = [(r.a is not None, r.a or 0, r.b) for r in sorted(ids, key=lambda r: r.id)]
    assert keys == sorted(keys)
    again = assign_ids(df.repartition(4), ["a", "b"], start=11, range_rows=range_rows).collect()
    assert {(r.c, r.id) for r in ids} == {(r.c, r.id) for r in again}


def test_segmented_scan_equals_a_scan_of_the_whole_key(spark):
    """One key holds most rows; every kind of scan, nulls and ties of blocks included."""
    from reelforge.operators.scans import segmented_scan
    rnd = random.Random(6)
    rows = [(0 if i % 4 else i % 3, i, rnd.choice([None, rnd.randrange(50)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    v = F.col("v")
    kinds = ("sum", "max_before", "last_before", "known_before")
    out = segmented_scan(df, ["k"], ["t"], F.floor(F.col("t") / 64), {f"o_{c}": (c, v) for c in kinds}).collect()
    seen, want = {}, {}
    for k, t, x in rows:
        past = seen.setdefault(k, [])
        known = [p for p in past if p is not None]
        want[k, t] = (sum(known) + (x or 0), max(known, default=None), past[-1] if past else None, known[-1] if known else None)
        past.append(x)
    assert {(r.k, r.t): tuple(r[f"o_{c}"] for c in kinds) for r in out} == want


def test_dominant_value_is_counted_in_more_than_one_task(spark):
    from reelforge.operators.sequence import ranked_values
    df = spark.range(0, 200_000, 1, 16).select(F.lit(1).alias("g"), F.lit(2.0).alias("v"))
    plan = ranked_values(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "rangepartitioning" not in plan
    assert [(r._c, r._before) for r in ranked_values(df, ["g"], "v").collect()] == [(200_000, 0)]


def test_no_sequence_query_has_a_window_on_the_bare_user(spark):
    import re
    for key in ("w01_prev_next", "w08_segmentation", "a12_flow_stats", "w14_window_starts", "t25_overlap_ratio", "j15_remove_overlaps",
                "t02_quantize", "w22_frame_counter"):
        plan = E.queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan):
            by = [x for x in spec.split(", ") if not re.search("ASC|DESC|specified", x)]
            carried = re.search(r"\b(_b|_blk|_cell)#\d+L? ASC", spec)  # counts per block, not rows
            assert len(by) != 1 or carried or not re.match(r"(user_id|video_id|piece_id)#", by[0]), (key, spec)


def test_blocked_frame_sequences_equal_windows(spark):
    """W9 / W12 / W17 / W22 give the same rows with the skew-safe strategy."""
    from reelforge.operators import timeline as TL
    df = spark.range(400).select((F.col("id") % 3).alias("v"), (F.col("id") * 200).alias("ts"),
                                 F.array(F.sqrt("id"), F.lit(1.0)).alias("vec"), F.sqrt("id").alias("x"),
                                 ((F.col("id") % 7) == 0).alias("chg"))
    b = F.floor(F.col("ts") / 3000)

    def same(a, c):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, c.select(*a.columns).collect()))
    same(FR.vector_frame_diff(df, ["v"], ["ts"], "vec"), FR.vector_frame_diff(df, ["v"], ["ts"], "vec", "blocked", b))
    same(TL.deltas(df, ["v"], ["ts"], ["x"]), TL.deltas(df, ["v"], ["ts"], ["x"], "blocked", b))
    same(FR.frame_counter(df, ["v"], "ts"), FR.frame_counter(df, ["v"], "ts", "blocked", b))
    same(FR.shot_durations(df, ["v"], "ts", "chg"), FR.shot_durations(df, ["v"], "ts", "chg", strategy="blocked", bucket=b))


def test_resolution_equals_brute_force_without_a_score_cut(spark):
    """Every title carries the hot token 'the'; long titles share one token
    with their only reference; some titles repeat, some share nothing."""
    words = ["red", "blue", "green", "gold", "rain", "fire", "moon", "sun"]
    qrows = [(i, f"the {words[i % 8]} {words[(i * 3) % 8]} {words[(i * 5 + 1) % 8]}") for i in range(60)]
    qrows += [(70, "a b c d e f lonely"), (71, "nothing here"), (72, None), (73, ""), (74, qrows[0][1])]
    rrows = [(100 + j, f"the {words[j % 8]} {words[(j * 7 + 2) % 8]}") for j in range(40)] + [(200, "lonely"), (201, None)]
    q = spark.createDataFrame(qrows, "qid long, qt string")
    r = spark.createDataFrame(rrows, "rid long, rt string")
    for k in (1, 3, 50):
        got = {(x.qid, x.rid, round(x.score, 6), x.rank) for x in M.resolve_best(q, r, "qid", "qt", "rid", "rt", k).collect()}
        want = set()
        for qi, qt in qrows:
            a = set((qt or "").split())
            sc = [(len(a & set(rt.split())) / len(a | set(rt.split())), ri) for ri, rt in rrows if rt and a & set(rt.split())]
            want |= {(qi, ri, round(s, 6), n + 1) for n, (s, ri) in enumerate(sorted(sc, key=lambda t: (-t[0], t[1]))[:k])}
        assert got == want


def test_pattern_join_finds_the_first_text(spark):
    films = spark.createDataFrame([("top gun",), ("grease",), ("up",), ("x",), ("",)], "film string")
    texts = spark.createDataFrame([
        (1, "stop gun original soundtrack"), (2, "grease film hits"), (3, "the grease"), (4, "top gun film"),
        (5, "cup of soundtrack"), (6, "x soundtrack"), (0, "soundtrack of grease")], "doc_id long, clean_name string")
    a = M.first_pattern_match(films, texts, "film", "clean_name", "doc_id").select("film", "doc_id").collect()
    assert sorted(map(tuple, a)) == [("grease", 2), ("top gun", 1), ("up", 5), ("x", 6)]


def test_first_per_key_on_a_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(0).alias("k"),
                                   ((F.col("id") * 7919) % 20011).alias("o"), F.col("id").alias("payload"))
    got = {r.k: (r.o, r.payload) for r in M.first_per_key(df, "k", ["o", "payload"]).collect()}
    w = Window.partitionBy("k").orderBy("o", "payload")
    want = {r.k: (r.o, r.payload) for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()}
    assert got == want


def test_assign_ids_dense_across_buckets(spark):
    from reelforge.operators.training import assign_ids
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("key"),
                                  F.col("id").alias("tie"))
    out = assign_ids(df, ["key", "tie"], start=10).collect()
    got = sorted((r.key, r.tie, r.id) for r in out)
    assert [x[2] for x in got] == list(range(10, 5010))


def test_assign_ids_takes_string_keys_and_uses_many_ranges(spark):
    from reelforge.operators.training import assign_ids
    df = spark.range(3000).select(F.concat(F.lit("k"), F.pmod(F.col("id") * 7919, F.lit(3000)).cast("string")).alias("key"))
    out = assign_ids(df, ["key"])
    rows = sorted((r.key, r.id) for r in out.collect())
    assert [i for _, i in rows] == list(range(1, 3001))
    assert assign_ids(df.limit(0), ["key"]).collect() == []
    assert sorted(r.id for r in assign_ids(df.limit(1), ["key"]).collect()) == [1]


def test_recognition_with_a_pair_that_many_items_share(spark):
    """A hot landmark pair (in every item) changes neither votes nor the pick."""
    from reelforge.operators import fingerprint as FP
    items = spark.createDataFrame([(i, f"hot pair x{i} y{i} z{i}") for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "hot pair x7 y7 z7"), (2, "hot pair"), (3, "solo"), (4, "nothing known here"),
                                  (5, None), (6, "")], "doc_id long, text string")
    index = FP.build_index(items)
    a = FP.recognise(docs, index, "doc_id", "text", 16).collect()
    b = FP.recognise(docs, index, "doc_id", "text", 16, salts=1).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    got = {r.doc_id: (r.item_id, r.votes) for r in a}
    assert got == {1: (7, 7), 2: (0, 1), 3: (None, None), 4: (None, None)}


def test_recognition_reads_the_texts_once(spark):
    import re
    plan = E.queries()["r02_recognise_chunks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*doc_id", plan)) == 1


def test_building_a_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    for key in ("r04_index_new_items", "w08_segmentation", "j02_resolve_best", "j08_first_pattern_match", "a05_column_stats_frames"):
        E.queries()[key](spark, SF)
    # Only the reading of table footers may run.
    assert len(tracker.getJobIdsForGroup(None)) - before <= 12
