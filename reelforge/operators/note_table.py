"""The symbolic feature table in one pass over the notes.

1. Notes are cut into blocks (piece, run of slices) by one exchange.  A block
   gives one row per part (last pitch, last onset, latest end); windows over
   these few rows give each block what came before it.
2. Windows inside the blocks then complete every note: the pitch step, the
   direction before, the gaps to the attacks before, the end of the sounding
   span before, the pitch-class set of its slice.
3. Every note becomes measures: (kind, value) with mergeable counters, added up
   per piece by one aggregate: histograms, moments, arcs per block, set counts.
4. Beginnings and ends of sounding spans go through blocks of time (a block
   leaves its integrals relative to the count it begins with).
5. All counters of a piece meet and become its row.

Rows that meet per piece in step 5: the values of bounded histograms, distinct
quarter lengths and pitch-class sets, and one row per block.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6
from reelforge.operators.notes import (ARPEGGIO_INTERVALS, BASS_BELOW, CHORDS, COMMON_SHARE, HIGH_ABOVE, KK_MAJOR,
                                       KK_MINOR, SPAN, STACCATO_BELOW_S, feature_source, meter_features)

#: Slices in a block.
SLICES = 8
#: Kinds of measures.
(PITCH, PITCH_CLASS, INTERVAL, LENGTH, DURATION, GAP, PART_GAP, ARC, PC_SET, SET_CLASS, VOICES) = range(11)
META = ["kind", "bpm", "num", "den"]


# --- pitch-class sets as 12 bits ---------------------------------------------------

def _transposed(mask: int) -> int:
    """The smallest number among the twelve rotations of a set of 12 bits."""
    return min(((mask << t) | (mask >> (12 - t))) & 4095 for t in range(12))


def _inverted(mask: int) -> int:
    return sum(1 << (12 - pc) % 12 for pc in range(12) if mask >> pc & 1)


def _looked_up(mask: Column, rule) -> Column:
    """A rule over all 4096 sets, as a constant array."""
    table = F.split(F.lit(",".join(str(rule(m)) for m in range(4096))), ",")
    return F.get(table, mask.cast("int")).cast("int")


def transposition_class(mask: Column) -> Column:
    return _looked_up(mask, _transposed)


def set_class(mask: Column) -> Column:
    """The smallest rotation of the set or of its inversion."""
    return _looked_up(mask, lambda m: min(_transposed(m), _transposed(_inverted(m))))


def _chord(name: str) -> int:
    return _transposed(sum(1 << pc for pc in CHORDS[name]))


def _tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions, named: the work here is in
    the computation, not in the bytes by which partitions would be put together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- notes completed by what came before ----------------------------------------------

def _completed(notes: DataFrame, slice_col: str) -> DataFrame:
    k, place = ["piece", "blk"], ["onset", "note_id"]
    n = notes.drop(*META).withColumn("end", F.col("onset") + F.col("dur"))
    totals = n.groupBy("piece", "blk", "part").agg(
        F.max_by(F.struct("pitch"), F.struct(*place)).alias("pitch"), F.max("onset").alias("onset"), F.max("end").alias("end"))
    parts = Window.partitionBy("piece", "part").orderBy("blk")
    earlier = Window.partitionBy("piece").orderBy("blk").rangeBetween(Window.unboundedPreceding, -1)
    came = (totals.repartition("piece").select(
        "piece", "blk", F.struct("part", F.lag("pitch").over(parts).alias("pitch"),
                                 F.lag("onset").over(parts).alias("onset"),
                                 F.max("end").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("until"),
                                 # the last block of a part ends its last sounding span
                                 F.when(F.lead("blk").over(parts).isNull(), F.max("end").over(
                                     parts.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("closes"),
                                 ).alias("p"), F.max("onset").over(earlier).alias("attack"))
            .groupBy("piece", "blk").agg(F.collect_list("p").alias("parts"), F.max("attack").alias("attack")))
    inside = Window.partitionBy(*k, "part").orderBy(*place)
    attacks = Window.partitionBy(*k).orderBy("onset")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = F.get(F.filter("parts", lambda p: p["part"].eqNullSafe(F.col("part"))), F.lit(0))
    n = n.join(came, k).withColumn("own", own).drop("parts")
    n = n.withColumns({
        "was": F.coalesce(F.lag(F.struct("pitch")).over(inside), F.col("own.pitch"))["pitch"],
        "part_gap": F.col("onset") - F.coalesce(F.lag("onset").over(inside), F.col("own.onset")),
        "until": F.greatest(F.max("end").over(before), F.col("own.until")),
        "closes": F.when(F.row_number().over(inside) == 1, F.col("own.closes")),
        "gap": F.col("onset") - F.coalesce(F.lag("onset").over(attacks), F.col("attack")),
        # the whole slice, at its first note
        "mask": F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("pitch", F.lit(12)).cast("int"))).over(
            Window.partitionBy(*k, slice_col)),
        "first": F.row_number().over(Window.partitionBy(*k, slice_col).orderBy(*place)) == 1,
    }).drop("own", "attack")
    n = n.withColumn("delta", F.col("pitch") - F.col("was")).drop("was")
    n = n.withColumn("sign", F.when(F.col("delta") != 0, F.signum("delta")).cast("long"))
    return n.withColumns({
        "sign_before": F.last("sign", ignorenulls=True).over(before), "set_class": set_class(F.col("mask")),
        # place in the block and sign as one number
        "turn": F.row_number().over(inside) * 4 + F.col("sign") + 1})


# --- measures ---------------------------------------------------------------------------

def _measures(n: DataFrame) -> DataFrame:
    """(piece, kind, part, value) with counters, one row per group."""
    num = "double"

    def m(kind: int, when: Column | None = None, part: Column | None = None, value: Column | None = None,
          x: Column | None = None, y: Column | None = None, turn: Column | None = None) -> Column:
        none = F.lit(None)
        row = F.struct(
            F.lit(kind).alias("kind"), (none if part is None else part).cast("string").alias("part"),
            (F.lit(0.0) if value is None else value.cast(num)).alias("value"),
            (none if x is None else x).cast(num).alias("x"), (none if y is None else y).cast(num).alias("y"),
            (none if turn is None else turn).cast("long").alias("turn"))
        return row if when is None else F.when(when, row)

    delta, sign = F.col("delta"), F.col("sign")
    turns = F.col("sign_before").isNotNull() & (sign != F.col("sign_before"))
    rows = F.array(
        m(PITCH, value=F.col("pitch")), m(PITCH_CLASS, value=F.pmod("pitch", F.lit(12)), x=F.col("dur")),
        m(INTERVAL, delta.isNotNull(), value=F.abs(delta), x=(delta > 0).cast("int")),
        m(LENGTH, value=F.col("ql")), m(DURATION, x=F.col("dur"), y=F.col("end")),
        m(GAP, F.col("gap") > 0, x=F.col("gap")), m(PART_GAP, F.col("part_gap") > 0, part=F.col("part"), x=F.col("part_gap")),
        m(ARC, sign.isNotNull(), part=F.col("part"), value=F.col("blk"), x=F.abs(delta), y=turns.cast("int"),
          turn=F.col("turn")),
        m(PC_SET, F.col("first"), value=F.col("mask")), m(SET_CLASS, F.col("first"), value=F.col("set_class")))
    x = F.col("m.x")
    return (n.select("piece", F.explode(rows).alias("m")).where("m IS NOT NULL")
            .groupBy("piece", F.col("m.kind").alias("kind"), F.col("m.part").alias("part"), F.col("m.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                 F.max(x).alias("most"), F.min(x).alias("least"), F.count(F.when(x < STACCATO_BELOW_S, 1)).alias("short"),
                 F.sum("m.y").alias("y"), F.max("m.y").alias("top"), F.min("m.turn").alias("first"), F.max("m.turn").alias("last")))


def _voice_blocks(n: DataFrame) -> DataFrame:
    """Per (piece, block of time): its first and last event, the net change, and
    integrals of the voice count and its square, relative to the count at the
    block's beginning."""
    def event(t: str, d: int, when: Column) -> Column:
        return F.when(when, F.struct(F.col(t).alias("t"), F.lit(d).alias("d")))

    opens = F.col("until").isNull() | (F.col("onset") > F.col("until"))
    ev = (n.select("piece", F.explode(F.array(event("onset", 1, opens), event("until", -1, opens & F.col("until").isNotNull()),
                                              event("closes", -1, F.col("closes").isNotNull()))).alias("e"))
          .where("e IS NOT NULL").select("piece", F.floor(F.col("e.t") / SPAN).alias("blk"), "e.t", "e.d"))
    ev = ev.repartition(_tasks(ev), "piece", "blk").groupBy("piece", "blk", "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("piece", "blk").orderBy("t")
    ev = ev.withColumns({
        "v": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "len": F.lead("t").over(w) - F.col("t")})
    v, length = F.col("v"), F.coalesce("len", F.lit(0.0))
    return ev.groupBy("piece", "blk").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.sum("d").alias("net"), F.sum(length).alias("len"),
        F.sum(v * length).alias("s1"), F.sum(v * v * length).alias("s2"),
        F.max(F.when(F.col("len").isNotNull(), v)).alias("vmax"))


# --- one row per piece -----------------------------------------------------------------------

#: Conditions on a histogram's values whose shares are features.
SHARES = {
    INTERVAL: [("RepeatedNotes", [0]), ("ChromaticMotion", [1]), ("StepwiseMotion", [1, 2]), ("MelodicThirds", [3, 4]),
               ("MelodicFifths", [7]), ("MelodicTritones", [6]), ("MelodicOctaves", [12]),
               ("AmountOfArpeggiation", ARPEGGIO_INTERVALS)],
    PITCH: [("ImportanceOfBassRegister", range(BASS_BELOW)),
            ("ImportanceOfMiddleRegister", range(BASS_BELOW, HIGH_ABOVE + 1)), ("ImportanceOfHighRegister", None)],
    PC_SET: [(f"{c}SimultaneityPrevalence", [_chord(c)]) for c in (
        "MajorTriad", "MinorTriad", "DominantSeventh", "DiminishedTriad", "DiminishedSeventh")]
    + [("TriadSimultaneityPrevalence", [_chord(c) for c in (
        "MajorTriad", "MinorTriad", "DiminishedTriad", "AugmentedTriad")])],
}
_SLOTS = max(map(len, SHARES.values()))


def _statistics() -> list[Column]:
    """What the counters of one (piece, kind) give; each kind uses some."""
    kind, n, value = F.col("kind"), F.col("n"), F.col("value")

    def slot(i: int) -> Column:
        """Notes that meet the i-th condition of the row's kind."""
        code, case = F.col("code"), F.lit(False)
        for k, names in SHARES.items():
            if i < len(names):
                wanted = names[i][1]
                meets = (value > HIGH_ABOVE if wanted is None else value < BASS_BELOW if wanted == range(BASS_BELOW)
                         else (value >= wanted[0]) & (value <= wanted[-1]) if isinstance(wanted, range)
                         else code.isin(*wanted))
                case = F.when(kind == k, meets).otherwise(case)
        return F.sum(F.when(case, n).otherwise(0)).alias(f"s{i}")

    first, second = F.col("rank") == 1, F.col("rank") == 2
    c, length, wait = F.col("carry"), F.col("len"), F.col("wait")
    return [F.count(F.lit(1)).alias("rows"), F.sum(n).alias("n"), F.sum(n * value).alias("nv"),
            F.sum(F.when(value.isNotNull(), n)).alias("known"), F.sum(F.when(value != 0, n)).alias("moves"),
            F.min(value).alias("low"), F.max(value).alias("high"),
            F.max(F.when(first, value)).alias("v1"), F.max(F.when(first, n)).alias("n1"),
            F.max(F.when(second, value)).alias("v2"), F.max(F.when(second, n)).alias("n2"),
            F.count(F.when(n / F.col("all") >= COMMON_SHARE, 1)).alias("common"),
            F.sum("x").alias("x"), F.sum("y").alias("y"), F.avg("mean").alias("mean"), F.avg("std").alias("std"),
            F.max("most").alias("most"), F.min("least").alias("least"), F.sum("short").alias("short"), F.max("top").alias("top"),
            F.count(F.when(F.col("turned"), 1)).alias("turned"), *[slot(i) for i in range(_SLOTS)],
            F.collect_list(F.when((kind == PITCH_CLASS) & value.isNotNull(), F.struct(value.cast("int"), "x"))).alias("pcs"),
            # Voices: from a block's last event to the next block's first the count stays.
            F.sum(length + wait).alias("whole"), F.sum(F.col("s1") + c * length + c * wait).alias("i1"),
            F.sum(F.col("s2") + 2 * c * F.col("s1") + c * c * length + c * c * wait).alias("i2"),
            F.max(F.greatest(c + F.col("vmax"), F.when(wait > 0, c))).alias("voices")]


def _features() -> list[Column]:
    """The features from ``k``, a map from kind to its statistics."""
    def of(kind: int):
        row = F.col("k")[kind]
        return lambda c: row[c]

    interval, pitch, pc, ql = of(INTERVAL), of(PITCH), of(PITCH_CLASS), of(LENGTH)
    dur, gap, part, arc, voice = of(DURATION), of(GAP), of(PART_GAP), of(ARC), of(VOICES)
    arcs, mean = arc("y") + arc("turned"), F.try_divide(voice("i1"), voice("whole"))
    out = {"AverageMelodicInterval": r6(interval("nv") / interval("n")),
           "DirectionOfMotion": r6(F.try_divide(interval("x"), interval("moves"))),
           "MostCommonMelodicInterval": interval("v1"),
           "MostCommonMelodicIntervalPrevalence": r6(interval("n1") / interval("n")),
           "DistanceBetweenMostCommonMelodicIntervals": F.abs(interval("v1") - interval("v2")),
           "RelativeStrengthOfMostCommonIntervals": r6(interval("n2") / interval("n1")),
           "NumberOfCommonMelodicIntervals": interval("common"),
           "DurationOfMelodicArcs": r6(arc("n") / arcs), "SizeOfMelodicArcs": r6(arc("x") / arcs),
           "Range": pitch("high") - pitch("low"), "PrimaryRegister": r6(pitch("nv") / pitch("known")),
           "NoteDensity": r6(F.try_divide(dur("n"), dur("top"))), "AverageNoteDuration": r6(dur("mean")),
           "VariabilityOfNoteDuration": r6(dur("std")), "MaximumNoteDuration": r6(dur("most")),
           "MinimumNoteDuration": r6(dur("least")), "StaccatoIncidence": r6(dur("short") / dur("n")),
           "Duration": r6(dur("top")), "AverageTimeBetweenAttacks": r6(gap("mean")),
           "VariabilityOfTimeBetweenAttacks": r6(gap("std")), "AverageTimeBetweenAttacksForEachVoice": r6(part("mean")),
           "AverageVariabilityOfTimeBetweenAttacksForEachVoice": r6(part("std")),
           "UniqueNoteQuarterLengths": ql("rows"), "MostCommonNoteQuarterLength": ql("v1"),
           "MostCommonNoteQuarterLengthPrevalence": r6(ql("n1") / ql("n")),
           "RangeOfNoteQuarterLengths": ql("high") - ql("low"),
           "MaximumNumberOfIndependentVoices": voice("voices"), "AverageNumberOfIndependentVoices": r6(mean),
           "VariabilityOfNumberOfIndependentVoices": r6(F.sqrt(F.greatest(
               F.try_divide(voice("i2"), voice("whole")) - mean * mean, F.lit(0.0))))}
    for h, prefix, plural in ((pitch, "Pitch", "Pitches"), (pc, "PitchClass", "PitchClasses")):
        out |= {f"MostCommon{prefix}": h("v1"), f"MostCommon{prefix}Prevalence": r6(h("n1") / h("n")),
                f"RelativeStrengthOfTop{plural}": r6(h("n2") / h("n1")),
                f"IntervalBetweenStrongest{plural}": F.abs(h("v1") - h("v2")),
                f"NumberOfCommon{plural}": h("common"), f"{prefix}Variety": h("rows")}
    for kind, name in ((PC_SET, "PitchClassSet"), (SET_CLASS, "SetClass")):
        h = of(kind)
        out |= {f"Unique{name}Simultaneities": h("rows"), f"MostCommon{name}SimultaneityPrevalence": r6(h("n1") / h("n"))}
    for kind, names in SHARES.items():
        h = of(kind)
        total = h("known") if kind == PITCH else h("n")
        out |= {name: r6(h(f"s{i}") / total) for i, (name, _) in enumerate(names)}
    return [c.alias(name) for name, c in out.items()]


def _profiles() -> str:
    """The 24 key profiles, centred and of length one, as constant JSON."""
    out = []
    for profile in (KK_MAJOR, KK_MINOR):
        mean = sum(profile) / 12
        length = sum((x - mean) ** 2 for x in profile) ** 0.5
        out += [[(profile[(pc - tonic) % 12] - mean) / length for pc in range(12)] for tonic in range(12)]
    return json.dumps(out)


def _key(pcs: Column) -> list[Column]:
    """M15 from (pitch class, duration) pairs: the key whose profile correlates
    best with the twelve durations (0 when absent), ties to the lowest key."""
    by_class = F.map_from_entries(pcs)
    vector = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda pc: F.coalesce(by_class[pc], F.lit(0.0)))
    total = F.aggregate(vector, F.lit(0.0), lambda acc, d: acc + d)
    spread = F.aggregate(vector, F.lit(0.0), lambda acc, d: acc + (d - total / 12) * (d - total / 12))
    products = F.transform(F.from_json(F.lit(_profiles()), "array<array<double>>"), lambda p: F.aggregate(
        F.zip_with(p, vector, lambda x, d: x * d), F.lit(0.0), lambda acc, x: acc + x))
    best = F.array_max(F.transform(products, lambda x, i: F.struct(F.round(x, 9).alias("near"), (-i).alias("key"), x.alias("x"))))
    known = spread > 0
    return [F.when(known, F.floor(-best["key"] / 12)).cast("int").alias("QualityFeature"),
            F.when(known, r6(best["x"] / F.sqrt(spread))).alias("TonalCertainty")]


def symbolic_feature_table(notes: DataFrame, slice_col: str = "slice", piece: str = "piece_id",
                           drop: str | None = None) -> DataFrame:
    """The symbolic feature table: one row per piece, the 73 named features in
    their fixed order (F9 select list; ``drop`` removes one name), null columns
    for those that are not built.

    ``notes``: piece, part, note_id, onset, dur, pitch, ql, ``slice_col``
    (numbered along the onset) and, null where a row is no meter event, kind
    ('tempo' / 'timesig'), bpm, num, den."""
    from reelforge.functions.names import symbolic_feature_names
    n = (notes.select(F.col(piece).alias("piece"), "part", "note_id", "onset", "dur", "pitch", "ql", slice_col, *META)
         .withColumn("blk", F.floor(F.col(slice_col) / SLICES)))
    # The joins below want known keys anyway; said here, all of them read one exchange.
    n = n.where("piece IS NOT NULL AND blk IS NOT NULL").repartition(_tasks(n), "piece", "blk")
    meter = meter_features(n.where("kind IS NOT NULL").withColumnRenamed("note_id", "event_id"), "piece")
    completed = _completed(n, slice_col)
    counters, voices = _measures(completed), _voice_blocks(completed)
    shape = {**{c: F.col(c) for c in counters.columns}, **{c: F.lit(None).cast(voices.schema[c].dataType) for c in (
        "t0", "t1", "net", "len", "s1", "s2", "vmax")}}
    rest = counters.select(*[c.alias(k) for k, c in shape.items()])
    own = {"piece": F.col("piece"), "kind": F.lit(VOICES), "value": F.col("blk").cast("double")}
    blocks = voices.select(*[
        (own[c] if c in own else F.col(c) if c in voices.columns else F.lit(None).cast(rest.schema[c].dataType)).alias(c)
        for c in rest.columns])
    u = rest.unionByName(blocks).repartition(_tasks(rest), "piece")
    ranks = Window.partitionBy("piece", "kind", "part").orderBy(F.col("n").desc(), "value")
    order = Window.partitionBy("piece", "kind", "part").orderBy("value")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    voices_row = F.col("kind") == VOICES
    u = u.withColumns({
        "rank": F.row_number().over(ranks), "all": F.sum("n").over(Window.partitionBy("piece", "kind", "part")),
        # arcs: a block goes on with the arc before, or begins one
        "turned": F.coalesce(F.lag(F.col("last") % 4).over(order) != F.col("first") % 4, F.lit(True)),
        "carry": F.when(voices_row, F.coalesce(F.sum("net").over(earlier), F.lit(0))),
        "wait": F.when(voices_row, F.coalesce(F.col("t0") - F.lag("t1").over(order), F.lit(0.0))),
        "code": F.when(F.col("kind") == PC_SET, transposition_class(F.col("value").cast("int")))
        .otherwise(F.col("value").cast("int"))})
    kinds = u.groupBy("piece", "kind").agg(*_statistics())
    entry = F.struct(F.col("kind"), F.struct(*[c for c in kinds.columns if c not in ("piece", "kind")]))
    row = kinds.groupBy("piece").agg(F.map_from_entries(F.collect_list(entry)).alias("k"))
    row = row.select("piece", *_features(), *_key(F.col("k")[PITCH_CLASS]["pcs"]))
    out = row.join(meter, "piece", "left")
    cols = []
    for name in symbolic_feature_names(drop):
        src = feature_source(name)
        c = F.col(f"`{src}`").cast("double") if src is not None else F.lit(None).cast("double")
        cols.append(c.alias(name))
    return out.select(F.col("piece").alias(piece), *cols)
