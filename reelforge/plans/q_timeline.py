"""Queries for timeline slicing / pooling (W16-W21) and note statistics (T2, M*, A14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelforge.operators import note_table as NT
from reelforge.operators import notes as N
from reelforge.operators import timeline as TL
from reelforge.plans.adapters import EVENTS_K_SQL, events_k, with_ctes
from reelforge.plans.q_frames import POS_BUCKET, SEQ_SQL, _seq
from reelforge.plans.registry import register
from reelforge.session import read_table


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _q(body, **extra):
    return with_ctes(body, events_k=EVENTS_K_SQL, seq=SEQ_SQL, **extra)


# ---- W16 / W17 / W18 ---------------------------------------------------------------------
@register("w16_mid_term_pool", _q(f"""
SELECT video_id, feature, {_r6('avg(m)')} AS mean_of_means, {_r6('avg(s)')} AS mean_of_stds, count(*) AS n_windows
FROM (SELECT video_id, win, feature, avg(v) AS m, stddev_pop(v) AS s FROM (
        SELECT video_id, win, 'value' AS feature, sqrt(value) AS v FROM x UNION ALL
        SELECT video_id, win, 'k', CAST(k AS DOUBLE) FROM x) GROUP BY 1, 2, 3)
GROUP BY 1, 2""", x="""SELECT * FROM (SELECT video_id, value, k, unnest([r * 50 // 1000, r * 50 // 1000 - 1]) AS win
  FROM seq) WHERE win >= 0"""))
def w16_mid_term_pool(spark, sf):
    s = _seq(spark, sf).select("video_id", (F.col("r") * 50).alias("ts_ms"), F.sqrt("value").alias("value"), "k")
    return TL.mid_term_pool(s, ["video_id"], "ts_ms", ["value", "k"], 2000, 1000)


@register("w17_deltas", _q("""SELECT video_id, event_id,
  coalesce(value - lag(value) OVER (PARTITION BY video_id ORDER BY r), 0.0) AS "delta value" FROM seq"""))
def w17_deltas(spark, sf):
    s = _seq(spark, sf)
    return TL.deltas(s, ["video_id"], ["r"], ["value"], "blocked", F.floor(F.col("r") / POS_BUCKET)).select(
        "video_id", "event_id", "delta value")


@register("w18_short_frame_features", _q(f"""
SELECT f.video_id, f.frame, {_r6('coalesce(f.z, 0.0) / 2 / (f.n - 1)')} AS zcr, {_r6('f.e / f.n')} AS energy,
  {_r6('b.ent')} AS energy_entropy
FROM (SELECT video_id, frame, count(*) AS n, sum(dz) AS z, sum(x * x) AS e FROM sm GROUP BY 1, 2) f
LEFT JOIN (SELECT video_id, frame, sum(-p * log2(p + 1e-8)) AS ent FROM (
   SELECT bb.video_id, bb.frame, bb.be / (ff.e + 1e-8) AS p FROM
     (SELECT video_id, frame, blk, sum(x * x) AS be FROM sm WHERE blk < 10 GROUP BY 1, 2, 3) bb
     JOIN (SELECT video_id, frame, sum(x * x) AS e FROM sm GROUP BY 1, 2) ff USING (video_id, frame))
   GROUP BY 1, 2) b USING (video_id, frame)""",
                                         sm="""SELECT video_id, frame, pos, x,
  abs(sign(x) - lag(sign(x)) OVER (PARTITION BY video_id, frame ORDER BY pos)) AS dz, pos // 2 AS blk FROM (
  SELECT video_id, r // 20 AS frame, r % 20 AS pos, value - 50.0 AS x, count(*) OVER (PARTITION BY video_id, r // 20) AS n
  FROM seq) WHERE n = 20"""))
def w18_short_frame_features(spark, sf):
    s = _seq(spark, sf).select("video_id", F.floor(F.col("r") / 20).alias("frame"), (F.col("r") % 20).alias("pos"),
                               (F.col("value") - 50.0).alias("x"))
    full = s.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("video_id", "frame"))).filter("_n = 20")
    return TL.short_frame_features(full.drop("_n"), ["video_id"], "frame", "pos", "x", 20, 10)


# ---- W19 / W20 / W21 -------------------------------------------------------------------------
@register("w19_fixed_chunks", """SELECT event_id, CAST(unnest(range(0, CAST(floor(value * 1000) AS BIGINT), 5000)) AS BIGINT)
  AS start FROM events WHERE floor(value * 1000) > 0""")
def w19_fixed_chunks(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", F.floor(F.col("value") * 1000).alias("len_ms"))
    return TL.fixed_chunks(e, "len_ms", 5000).select("event_id", "start")


_W20_C = "CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 15 END"
_W20_L = "round_even(o_totalprice / 1000, 0)"


@register("w20_full_chunks", f"""SELECT o_orderkey, i * {_W20_C} AS chunk_index,
  (o_orderkey % 97) * 5000 / 1000 + i * {_W20_C} AS starting_point FROM (
  SELECT *, unnest(range(0, CAST(floor({_W20_L} / {_W20_C}) AS BIGINT))) AS i FROM orders
  WHERE {_W20_C} > 0 AND floor({_W20_L} / {_W20_C}) >= 1)""")
def w20_full_chunks(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.bround(F.col("o_totalprice") / 1000, 0).alias("length_s"),
        F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(15).alias("chunk_s"),
        ((F.col("o_orderkey") % 97) * 5000).alias("start"))
    return TL.full_chunks(o, "length_s", "chunk_s", "start").select("o_orderkey", "chunk_index", "starting_point")


@register("w21_batches", """SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 200 AS BIGINT)
  AS batch FROM orders""")
def w21_batches(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return TL.batches(o, ["o_orderkey"], 200).select("o_orderkey", "batch")


# ---- notes ------------------------------------------------------------------------------------
def _with_first(events):
    """Events with the first time of their piece, by a partial aggregate joined back."""
    return events.join(events.groupBy("user_id").agg(F.min("ts").alias("_first")), "user_id")


def _notes(spark, sf):
    e = _with_first(events_k(spark, sf))
    onset = F.timestamp_diff("MICROSECOND", F.col("_first"), F.col("ts")) / 3.6e9
    dur = 0.05 + F.col("value") / 100
    return e.select(F.col("user_id").alias("piece_id"), F.col("event_type").alias("part"),
                    F.col("event_id").alias("note_id"), onset.alias("onset"), dur.alias("dur"),
                    (36 + F.col("k") % 60).alias("pitch"), (F.bround(dur * 4, 0) / 4).alias("ql"))


NOTES_SQL = """SELECT user_id AS piece_id, event_type AS part, event_id AS note_id,
  (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 3.6e9 AS onset, 0.05 + value / 100 AS dur,
  36 + k % 60 AS pitch, round_even((0.05 + value / 100) * 4, 0) / 4 AS ql FROM events_k"""


def _n(body, **extra):
    return with_ctes(body, events_k=EVENTS_K_SQL, notes=NOTES_SQL, **extra)


@register("t02_quantize", _n("""SELECT note_id, CASE
  WHEN abs(onset - round_even(onset * 12, 0) / 12) < abs(onset - round_even(onset * 16, 0) / 16)
  THEN round_even(onset * 12, 0) / 12 ELSE round_even(onset * 16, 0) / 16 END AS q FROM notes"""))
def t02_quantize(spark, sf):
    return _notes(spark, sf).select("note_id", N.quantize("onset").alias("q"))


_IV_SQL = "SELECT *, pitch - lag(pitch) OVER (PARTITION BY piece_id, part ORDER BY onset, note_id) AS delta FROM notes"


def _sh(cond: str) -> str:
    return _r6(f"count(*) FILTER (WHERE {cond}) / count(delta)")


@register("m01_melodic_intervals", _n(f"""SELECT piece_id, {_r6('avg(abs(delta))')} AS AverageMelodicInterval,
  {_sh('abs(delta) = 0')} AS RepeatedNotes, {_sh('abs(delta) = 1')} AS ChromaticMotion,
  {_sh('abs(delta) IN (1, 2)')} AS StepwiseMotion, {_sh('abs(delta) IN (3, 4)')} AS MelodicThirds,
  {_sh('abs(delta) = 7')} AS MelodicFifths, {_sh('abs(delta) = 6')} AS MelodicTritones,
  {_sh('abs(delta) = 12')} AS MelodicOctaves,
  {_sh('abs(delta) IN (' + ', '.join(map(str, N.ARPEGGIO_INTERVALS)) + ')')} AS AmountOfArpeggiation,
  {_r6('count(*) FILTER (WHERE delta > 0) / nullif(count(*) FILTER (WHERE delta <> 0), 0)')} AS DirectionOfMotion
FROM iv GROUP BY 1""", iv=_IV_SQL))
def m01_melodic_intervals(spark, sf):
    return N.melodic_features(N.with_intervals(_notes(spark, sf)))


def _top_sql(v: str, p: str, pl: str) -> str:
    return _n(f"""SELECT piece_id, max(CASE WHEN rn = 1 THEN v END) AS MostCommon{p},
  {_r6('max(CASE WHEN rn = 1 THEN c / t END)')} AS MostCommon{p}Prevalence,
  {_r6('max(CASE WHEN rn = 2 THEN c END) / max(CASE WHEN rn = 1 THEN c END)')} AS RelativeStrengthOfTop{pl},
  abs(max(CASE WHEN rn = 1 THEN v END) - max(CASE WHEN rn = 2 THEN v END)) AS IntervalBetweenStrongest{pl},
  count(*) FILTER (WHERE c / t >= {N.COMMON_SHARE}) AS NumberOfCommon{pl}, count(*) AS {p}Variety
FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY c DESC, v) AS rn,
             sum(c) OVER (PARTITION BY piece_id) AS t
      FROM (SELECT piece_id, {v} AS v, count(*) AS c FROM notes GROUP BY 1, 2)) GROUP BY 1""")


@register("m05_pitch_stats", _top_sql("pitch", "Pitch", "Pitches"))
def m05_pitch_stats(spark, sf):
    return N.top_two(_notes(spark, sf).select("piece_id", F.col("pitch").alias("v")), "piece_id", "v", "Pitch",
                     "Pitches")


@register("m06_pitch_class_stats", _top_sql("pitch % 12", "PitchClass", "PitchClasses"))
def m06_pitch_class_stats(spark, sf):
    n = _notes(spark, sf).select("piece_id", F.pmod("pitch", F.lit(12)).alias("v"))
    return N.top_two(n, "piece_id", "v", "PitchClass", "PitchClasses")


@register("m12_quarter_lengths", _n(f"""SELECT piece_id, t.UniqueNoteQuarterLengths, t.MostCommonNoteQuarterLength,
  t.MostCommonNoteQuarterLengthPrevalence, r.RangeOfNoteQuarterLengths
FROM (SELECT piece_id, count(*) AS UniqueNoteQuarterLengths, max(CASE WHEN rn = 1 THEN v END) AS MostCommonNoteQuarterLength,
             {_r6('max(CASE WHEN rn = 1 THEN c / t END)')} AS MostCommonNoteQuarterLengthPrevalence
      FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY c DESC, v) AS rn, sum(c) OVER (PARTITION BY piece_id) AS t
            FROM (SELECT piece_id, ql AS v, count(*) AS c FROM notes GROUP BY 1, 2)) GROUP BY 1) t
JOIN (SELECT piece_id, max(ql) - min(ql) AS RangeOfNoteQuarterLengths FROM notes GROUP BY 1) r USING (piece_id)"""))
def m12_quarter_lengths(spark, sf):
    return N.quarter_length_features(_notes(spark, sf))


@register("m07_register", _n(f"""SELECT piece_id, max(pitch) - min(pitch) AS Range, {_r6('avg(pitch)')} AS PrimaryRegister,
  {_r6(f'count(*) FILTER (WHERE pitch < {N.BASS_BELOW}) / count(pitch)')} AS ImportanceOfBassRegister,
  {_r6(f'count(*) FILTER (WHERE pitch >= {N.BASS_BELOW} AND pitch <= {N.HIGH_ABOVE}) / count(pitch)')}
    AS ImportanceOfMiddleRegister,
  {_r6(f'count(*) FILTER (WHERE pitch > {N.HIGH_ABOVE}) / count(pitch)')} AS ImportanceOfHighRegister
FROM notes GROUP BY 1"""))
def m07_register(spark, sf):
    return N.register_features(_notes(spark, sf))


@register("m08_durations", _n(f"""SELECT piece_id, {_r6('count(*) / max(onset + dur)')} AS NoteDensity,
  {_r6('avg(dur)')} AS AverageNoteDuration, {_r6('stddev_pop(dur)')} AS VariabilityOfNoteDuration,
  {_r6('max(dur)')} AS MaximumNoteDuration, {_r6('min(dur)')} AS MinimumNoteDuration,
  {_r6(f'count(*) FILTER (WHERE dur < {N.STACCATO_BELOW_S}) / count(dur)')} AS StaccatoIncidence,
  {_r6('max(onset + dur)')} AS Duration FROM notes GROUP BY 1"""))
def m08_durations(spark, sf):
    return N.duration_features(_notes(spark, sf))


@register("m16_note_list", _n("""SELECT note_id, greatest(unnest([pitch, pitch + 4, pitch - 40]), 0) AS pitch
FROM notes"""))
def m16_note_list(spark, sf):
    n = _notes(spark, sf).select("note_id", F.array("pitch", F.col("pitch") + 4, F.col("pitch") - 40).alias("pitches"))
    return N.note_list(n).select("note_id", "pitch")


@register("a14_measure_pitch_weights", _n(f"""SELECT piece_id, measure, pitch, {_r6('weight')} AS weight, rank, lowest
FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, measure ORDER BY weight DESC, pitch) AS rank,
             min(pitch) OVER (PARTITION BY piece_id, measure) AS lowest
      FROM (SELECT piece_id, CAST(floor(onset) AS BIGINT) AS measure, pitch, sum(dur) AS weight FROM notes GROUP BY 1, 2, 3))
WHERE rank <= 4"""))
def a14_measure_pitch_weights(spark, sf):
    n = _notes(spark, sf).withColumn("measure", F.floor("onset"))
    return N.measure_pitch_weights(n, "piece_id", "measure", 4)


# ---- M2 / M4 / M9 / M10 / M11 / M13 / M14 / M15 -------------------------------------------------
@register("m02_interval_histogram", _n(f"""SELECT piece_id, abs(delta) AS interval, count(*) AS count,
  {_r6('count(*) / sum(count(*)) OVER (PARTITION BY piece_id)')} AS share FROM iv WHERE delta IS NOT NULL
GROUP BY 1, 2""", iv=_IV_SQL))
def m02_interval_histogram(spark, sf):
    return N.interval_histogram(N.with_intervals(_notes(spark, sf)))


@register("m02_interval_features", _n(f"""SELECT piece_id, max(CASE WHEN rn = 1 THEN v END) AS MostCommonMelodicInterval,
  {_r6('max(CASE WHEN rn = 1 THEN c / t END)')} AS MostCommonMelodicIntervalPrevalence,
  abs(max(CASE WHEN rn = 1 THEN v END) - max(CASE WHEN rn = 2 THEN v END)) AS DistanceBetweenMostCommonMelodicIntervals,
  {_r6('max(CASE WHEN rn = 2 THEN c END) / max(CASE WHEN rn = 1 THEN c END)')} AS RelativeStrengthOfMostCommonIntervals,
  count(*) FILTER (WHERE c / t >= {N.COMMON_SHARE}) AS NumberOfCommonMelodicIntervals
FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY c DESC, v) AS rn, sum(c) OVER (PARTITION BY piece_id) AS t
      FROM (SELECT piece_id, abs(delta) AS v, count(*) AS c FROM iv WHERE delta IS NOT NULL GROUP BY 1, 2)) GROUP BY 1""",
                                          iv=_IV_SQL))
def m02_interval_features(spark, sf):
    return N.interval_features(N.with_intervals(_notes(spark, sf)))


@register("m04_melodic_arcs", _n(f"""SELECT piece_id, {_r6('avg(n)')} AS DurationOfMelodicArcs,
  {_r6('avg(size)')} AS SizeOfMelodicArcs FROM (
  SELECT piece_id, part, arc, count(*) AS n, abs(sum(delta)) AS size FROM (
    SELECT *, sum(turn) OVER (PARTITION BY piece_id, part ORDER BY onset, note_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS arc FROM (
      SELECT *, CASE WHEN lag(sg) OVER w IS NULL OR lag(sg) OVER w <> sg THEN 1 ELSE 0 END AS turn FROM (
        SELECT *, sign(delta) AS sg FROM iv WHERE delta IS NOT NULL AND delta <> 0)
      WINDOW w AS (PARTITION BY piece_id, part ORDER BY onset, note_id)))
  GROUP BY 1, 2, 3) GROUP BY 1""", iv=_IV_SQL))
def m04_melodic_arcs(spark, sf):
    return N.melodic_arcs(N.with_intervals(_notes(spark, sf)))


@register("m09_attack_spacing", _n(f"""SELECT piece_id, w.AverageTimeBetweenAttacks, w.VariabilityOfTimeBetweenAttacks,
  v.AverageTimeBetweenAttacksForEachVoice, v.AverageVariabilityOfTimeBetweenAttacksForEachVoice
FROM (SELECT piece_id, {_r6('avg(g)')} AS AverageTimeBetweenAttacks, {_r6('stddev_pop(g)')} AS VariabilityOfTimeBetweenAttacks
      FROM (SELECT piece_id, onset - lag(onset) OVER (PARTITION BY piece_id ORDER BY onset) AS g
            FROM (SELECT DISTINCT piece_id, onset FROM notes)) WHERE g IS NOT NULL GROUP BY 1) w
FULL JOIN (SELECT piece_id, {_r6('avg(a)')} AS AverageTimeBetweenAttacksForEachVoice,
                  {_r6('avg(s)')} AS AverageVariabilityOfTimeBetweenAttacksForEachVoice
           FROM (SELECT piece_id, part, avg(g) AS a, stddev_pop(g) AS s
                 FROM (SELECT piece_id, part, onset - lag(onset) OVER (PARTITION BY piece_id, part ORDER BY onset) AS g
                       FROM (SELECT DISTINCT piece_id, part, onset FROM notes)) WHERE g IS NOT NULL GROUP BY 1, 2)
           GROUP BY 1) v USING (piece_id)"""))
def m09_attack_spacing(spark, sf):
    return N.attack_spacing(_notes(spark, sf))


@register("m10_voice_counts", _n(f"""SELECT piece_id, CAST(max(v) AS BIGINT) AS MaximumNumberOfIndependentVoices,
  {_r6('max(m)')} AS AverageNumberOfIndependentVoices,
  {_r6('sqrt(sum(len * pow(v - m, 2)) / sum(len))')} AS VariabilityOfNumberOfIndependentVoices
FROM (SELECT *, sum(v * len) OVER (PARTITION BY piece_id) / sum(len) OVER (PARTITION BY piece_id) AS m FROM (
  SELECT piece_id, t, sum(d) OVER (PARTITION BY piece_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v,
         lead(t) OVER (PARTITION BY piece_id ORDER BY t) - t AS len
  FROM (SELECT piece_id, t, sum(d) AS d FROM (
          SELECT piece_id, s AS t, 1 AS d FROM sp UNION ALL SELECT piece_id, e, -1 FROM sp) GROUP BY 1, 2))
  WHERE len IS NOT NULL)
GROUP BY 1""", n1="""SELECT *, onset + dur AS e, max(onset + dur) OVER (PARTITION BY piece_id, part ORDER BY onset, note_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM notes""",
                                    n2="""SELECT *, sum(CASE WHEN pe IS NULL OR onset > pe THEN 1 ELSE 0 END) OVER (
  PARTITION BY piece_id, part ORDER BY onset, note_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM n1""",
                                    sp="SELECT piece_id, part, isl, min(onset) AS s, max(e) AS e FROM n2 GROUP BY 1, 2, 3"))
def m10_voice_counts(spark, sf):
    return N.voice_counts(_notes(spark, sf))


def _meta(spark, sf):
    e = _with_first(events_k(spark, sf))
    k = F.col("k")
    return e.select(F.col("user_id").alias("piece_id"), "event_id",
                    (F.timestamp_diff("MICROSECOND", F.col("_first"), F.col("ts")) / 3.6e9).alias("onset"),
                    F.when(F.col("event_type") == "signup", "tempo").when(F.col("event_type") == "purchase", "timesig")
                    .alias("kind"), (60 + k % 120).alias("bpm"), (2 + k % 6).alias("num"),
                    F.when(k % 7 == 0, 0).when(k % 2 == 0, 4).otherwise(8).alias("den"))


_META_SQL = """SELECT user_id AS piece_id, event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 3.6e9 AS onset,
  CASE WHEN event_type = 'signup' THEN 'tempo' WHEN event_type = 'purchase' THEN 'timesig' END AS kind,
  60 + k % 120 AS bpm, 2 + k % 6 AS num, CASE WHEN k % 7 = 0 THEN 0 WHEN k % 2 = 0 THEN 4 ELSE 8 END AS den FROM events_k"""


@register("m11_meter", with_ctes(f"""SELECT piece_id, tp.InitialTempo, sig.InitialTimeSignature, sig.CompoundOrSimpleMeter,
  sig.TripleMeter, sig.QuintupleMeter, sig.ChangesOfMeter
FROM (SELECT piece_id, bpm AS InitialTempo FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY onset, event_id)
      AS rn FROM meta WHERE kind = 'tempo') WHERE rn = 1) tp
FULL JOIN (SELECT f.piece_id, {_r6('CASE WHEN f.den = 0 THEN NULL ELSE f.num / f.den END')} AS InitialTimeSignature,
      CASE WHEN f.num >= 6 AND f.num % 3 = 0 THEN 1 ELSE 0 END AS CompoundOrSimpleMeter,
      CASE WHEN f.num = 3 THEN 1 ELSE 0 END AS TripleMeter, CASE WHEN f.num = 5 THEN 1 ELSE 0 END AS QuintupleMeter,
      CASE WHEN c.nk > 1 THEN 1 ELSE 0 END AS ChangesOfMeter
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY onset, event_id) AS rn
          FROM meta WHERE kind = 'timesig') WHERE rn = 1) f
    JOIN (SELECT piece_id, count(DISTINCT (num, den)) AS nk FROM meta WHERE kind = 'timesig' GROUP BY 1) c
    USING (piece_id)) sig USING (piece_id)""", events_k=EVENTS_K_SQL, meta=_META_SQL))
def m11_meter(spark, sf):
    return N.meter_features(_meta(spark, sf))


_TCLASS_SQL = "list_min(list_transform(range(12), lambda t: list_sort(list_transform({x}, lambda p: (p + t) % 12))))"
_SLICES_SQL = f"""SELECT piece_id, slice, pcs, {_TCLASS_SQL.format(x='pcs')} AS t_class,
  CAST(list_min([{_TCLASS_SQL.format(x="pcs")}, {_TCLASS_SQL.format(x="list_transform(pcs, lambda p: (12 - p) % 12)")}]) AS INTEGER[]) AS set_class
FROM (SELECT piece_id, CAST(floor(onset / 24) AS BIGINT) AS slice, list_sort(list_distinct(list(pitch % 12))) AS pcs
      FROM notes GROUP BY 1, 2)"""


def _chord_sql(name):
    lit = "[" + ", ".join(map(str, N.CHORDS[name])) + "]"
    return _TCLASS_SQL.format(x=lit)


@register("m13_simultaneities", _n(f"""SELECT piece_id, a.u1 AS UniquePitchClassSetSimultaneities,
  {_r6('a.m1 / a.t1')} AS MostCommonPitchClassSetSimultaneityPrevalence,
  b.u2 AS UniqueSetClassSimultaneities, {_r6('b.m2 / b.t2')} AS MostCommonSetClassSimultaneityPrevalence,
  {_r6("avg(CASE WHEN t_class = " + _chord_sql('MajorTriad') + " THEN 1.0 ELSE 0.0 END)")} AS MajorTriadSimultaneityPrevalence,
  {_r6("avg(CASE WHEN t_class = " + _chord_sql('MinorTriad') + " THEN 1.0 ELSE 0.0 END)")} AS MinorTriadSimultaneityPrevalence,
  {_r6("avg(CASE WHEN t_class = " + _chord_sql('DominantSeventh') + " THEN 1.0 ELSE 0.0 END)")} AS DominantSeventhSimultaneityPrevalence,
  {_r6("avg(CASE WHEN t_class = " + _chord_sql('DiminishedTriad') + " THEN 1.0 ELSE 0.0 END)")} AS DiminishedTriadSimultaneityPrevalence,
  {_r6("avg(CASE WHEN t_class = " + _chord_sql('DiminishedSeventh') + " THEN 1.0 ELSE 0.0 END)")} AS DiminishedSeventhSimultaneityPrevalence,
  {_r6("avg(CASE WHEN t_class IN (" + ", ".join(_chord_sql(n) for n in ('MajorTriad', 'MinorTriad', 'DiminishedTriad', 'AugmentedTriad')) + ") THEN 1.0 ELSE 0.0 END)")} AS TriadSimultaneityPrevalence
FROM sl JOIN (SELECT piece_id, count(*) AS u1, max(c) AS m1, sum(c) AS t1 FROM
              (SELECT piece_id, pcs, count(*) AS c FROM sl GROUP BY 1, 2) GROUP BY 1) a USING (piece_id)
JOIN (SELECT piece_id, count(*) AS u2, max(c) AS m2, sum(c) AS t2 FROM
      (SELECT piece_id, set_class, count(*) AS c FROM sl GROUP BY 1, 2) GROUP BY 1) b USING (piece_id)
GROUP BY piece_id, a.u1, a.m1, a.t1, b.u2, b.m2, b.t2""", sl=_SLICES_SQL))
def m13_simultaneities(spark, sf):
    n = _notes(spark, sf).withColumn("slice", F.floor(F.col("onset") / 24))  # one slice per day
    return N.simultaneity_features(N.simultaneities(n, "slice"))


@register("m13_slice_sets", _n("SELECT piece_id, slice, pcs, set_class FROM sl", sl=_SLICES_SQL))
def m13_slice_sets(spark, sf):
    n = _notes(spark, sf).withColumn("slice", F.floor(F.col("onset") / 24))
    return N.simultaneities(n, "slice").select("piece_id", "slice", "pcs", "set_class")


_PROF_SQL = ("SELECT CAST(mode * 12 + tonic AS INTEGER) AS key, CAST(mode AS INTEGER) AS mode, pc, CASE WHEN mode = 0 THEN "
             + "(" + "[" + ", ".join(map(str, N.KK_MAJOR)) + "]::DOUBLE[])" + "[((pc - tonic + 12) % 12) + 1] ELSE "
             + "(" + "[" + ", ".join(map(str, N.KK_MINOR)) + "]::DOUBLE[])" + "[((pc - tonic + 12) % 12) + 1] END AS weight "
             + "FROM range(2) m(mode), range(12) t(tonic), range(12) p(pc)")


@register("m15_key_profiles", _n(f"""SELECT piece_id, mode AS QualityFeature, {_r6('r')} AS TonalCertainty FROM (
  SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY r DESC, key) AS rn FROM (
    SELECT v.piece_id, p.key, p.mode, corr(v.d, p.weight) AS r
    FROM (SELECT g.piece_id, g.pc, coalesce(b.d, 0.0) AS d
          FROM (SELECT DISTINCT piece_id, unnest(range(12)) AS pc FROM notes) g
          LEFT JOIN (SELECT piece_id, pitch % 12 AS pc, sum(dur) AS d FROM notes GROUP BY 1, 2) b USING (piece_id, pc)) v
    JOIN prof p USING (pc) GROUP BY 1, 2, 3) WHERE r IS NOT NULL) WHERE rn = 1""", prof=_PROF_SQL))
def m15_key_profiles(spark, sf):
    return N.key_features(_notes(spark, sf))


# ---- symbolic feature table (M1-M16 assembled) and F9 --------------------------------------------
_PARTS = ["m01_melodic_intervals", "m02_interval_features", "m04_melodic_arcs", "m05_pitch_stats",
          "m06_pitch_class_stats", "m07_register", "m08_durations", "m09_attack_spacing", "m10_voice_counts",
          "m11_meter", "m12_quarter_lengths", "m13_simultaneities", "m15_key_profiles"]


def _symbolic_sql(drop: str | None = None) -> str:
    from reelforge.functions.names import symbolic_feature_names
    from reelforge.plans.registry import _ORACLE
    sel = ", ".join(
        (f'CAST("{N.feature_source(n)}" AS DOUBLE)' if N.feature_source(n) else "CAST(NULL AS DOUBLE)") + f' AS "{n}"'
        for n in symbolic_feature_names(drop))
    joins = " ".join(f"LEFT JOIN ({_ORACLE[k]}) {k} USING (piece_id)" for k in _PARTS)
    return f"SELECT piece_id, {sel} FROM (SELECT DISTINCT user_id AS piece_id FROM events) b {joins}"


def _notes_and_meta(spark, sf):
    """Notes with the meter event of the same row, numbered by slices of a day."""
    e = _with_first(events_k(spark, sf))
    k = F.col("k")
    onset = F.timestamp_diff("MICROSECOND", F.col("_first"), F.col("ts")) / 3.6e9
    dur = 0.05 + F.col("value") / 100
    return e.select(F.col("user_id").alias("piece_id"), F.col("event_type").alias("part"),
                    F.col("event_id").alias("note_id"), onset.alias("onset"), dur.alias("dur"),
                    (36 + k % 60).alias("pitch"), (F.bround(dur * 4, 0) / 4).alias("ql"),
                    F.floor(onset / 24).alias("slice"),
                    F.when(F.col("event_type") == "signup", "tempo").when(F.col("event_type") == "purchase", "timesig")
                    .alias("kind"), (60 + k % 120).alias("bpm"), (2 + k % 6).alias("num"),
                    F.when(k % 7 == 0, 0).when(k % 2 == 0, 4).otherwise(8).alias("den"))


@register("m00_symbolic_feature_table", _symbolic_sql())
def m00_symbolic_feature_table(spark, sf):
    return NT.symbolic_feature_table(_notes_and_meta(spark, sf))


F09_DROP = "TonalCertainty"


@register("f09_allowed_features", _symbolic_sql(F09_DROP))
def f09_allowed_features(spark, sf):
    return NT.symbolic_feature_table(_notes_and_meta(spark, sf), drop=F09_DROP)
