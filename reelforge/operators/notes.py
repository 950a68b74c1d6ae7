"""Note-event statistics as Spark aggregates.

Input: note rows ``(piece_id, part, onset, dur, pitch, ql)``.  Definitions
follow the published symbolic-feature catalogue; every feature is a grouped
aggregate per piece (partial, map-side).  What needs the order of notes
(intervals, arcs, attacks, sounding spans, voices) runs as segmented scans
over blocks of ``SPAN`` units of onset, so no task holds a piece or a part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6
from reelforge.operators.scans import BLOCK, segmented_scan

#: Units of onset in a block.
SPAN = 256.0

# Fixed values (semitones): interval sets of the melodic features.
ARPEGGIO_INTERVALS = [0, 3, 4, 7, 10, 11, 12, 15, 16]
COMMON_SHARE = 0.09
BASS_BELOW, HIGH_ABOVE = 55, 72
STACCATO_BELOW_S = 0.1


def quantize(x, divisors: Sequence[int] = (16, 12)) -> Column:
    """Snap a time (in quarter lengths) to the nearest point of any of the
    grids 1/d; ties go to the first divisor.  Half-even rounding on the grid."""
    v = F.col(x) if isinstance(x, str) else x
    cands = F.array(*[F.struct(F.abs(v - F.bround(v * d, 0) / d).alias("err"), F.lit(i).alias("i"),
                               (F.bround(v * d, 0) / d).alias("q")) for i, d in enumerate(divisors)])
    return F.array_min(cands)["q"]


def note_list(df: DataFrame, pitches: str = "pitches") -> DataFrame:
    """Notes and chords to one row per note, pitch floored at 0."""
    return df.withColumn("pitch", F.explode(pitches)).withColumn("pitch", F.greatest(F.col("pitch"), F.lit(0)))


def with_intervals(notes: DataFrame, piece: str = "piece_id", part: str = "part",
                   order: Sequence[str] = ("onset", "note_id")) -> DataFrame:
    """Notes with ``delta``, the pitch step from the note before in the part."""
    n = segmented_scan(notes, [piece, part], order, F.floor(F.col(order[0]) / SPAN),
                       {"_before": ("last_before", F.col("pitch"))})
    return n.withColumn("delta", F.col("pitch") - F.col("_before")).drop("_before", BLOCK)


def _share(cond: Column, over: Column) -> Column:
    return F.count(F.when(cond, 1)) / F.count(over)


def melodic_features(iv: DataFrame, piece: str = "piece_id") -> DataFrame:
    """M1 + M3 from :func:`with_intervals`."""
    a = F.abs(F.col("delta"))
    d = F.col("delta")
    return iv.groupBy(piece).agg(
        r6(F.avg(a)).alias("AverageMelodicInterval"),
        r6(_share(a == 0, d)).alias("RepeatedNotes"),
        r6(_share(a == 1, d)).alias("ChromaticMotion"),
        r6(_share(a.isin(1, 2), d)).alias("StepwiseMotion"),
        r6(_share(a.isin(3, 4), d)).alias("MelodicThirds"),
        r6(_share(a == 7, d)).alias("MelodicFifths"),
        r6(_share(a == 6, d)).alias("MelodicTritones"),
        r6(_share(a == 12, d)).alias("MelodicOctaves"),
        r6(_share(a.isin(*ARPEGGIO_INTERVALS), d)).alias("AmountOfArpeggiation"),
        r6(F.try_divide(F.count(F.when(d > 0, 1)), F.count(F.when(d != 0, 1)))).alias("DirectionOfMotion"))


def top_two(values: DataFrame, piece: str, value: str, prefix: str, plural: str | None = None) -> DataFrame:
    """M5 / M6 / M12 pattern: histogram of ``value`` per piece, most common
    (ties to the lowest value), its prevalence, second-to-first strength,
    distance of the two strongest, number of values with share >= 0.09 and
    the variety (distinct values).  Two small aggregates, no collect."""
    pl = plural or prefix + "s"
    h = values.groupBy(piece, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(piece).orderBy(F.col("_c").desc(), F.col(value))
    r = h.withColumn("_r", F.row_number().over(w)).withColumn("_t", F.sum("_c").over(Window.partitionBy(piece)))
    return r.groupBy(piece).agg(
        F.max(F.when(F.col("_r") == 1, F.col(value))).alias(f"MostCommon{prefix}"),
        r6(F.max(F.when(F.col("_r") == 1, F.col("_c") / F.col("_t")))).alias(f"MostCommon{prefix}Prevalence"),
        r6(F.max(F.when(F.col("_r") == 2, F.col("_c"))) / F.max(F.when(F.col("_r") == 1, F.col("_c"))))
        .alias(f"RelativeStrengthOfTop{pl}"),
        F.abs(F.max(F.when(F.col("_r") == 1, F.col(value))) - F.max(F.when(F.col("_r") == 2, F.col(value))))
        .alias(f"IntervalBetweenStrongest{pl}"),
        F.count(F.when(F.col("_c") / F.col("_t") >= COMMON_SHARE, 1)).alias(f"NumberOfCommon{pl}"),
        F.count(F.lit(1)).alias(f"{prefix}Variety"))


def register_features(notes: DataFrame, piece: str = "piece_id") -> DataFrame:
    """M7: range, mean pitch and register shares."""
    p = F.col("pitch")
    return notes.groupBy(piece).agg(
        (F.max(p) - F.min(p)).alias("Range"), r6(F.avg(p)).alias("PrimaryRegister"),
        r6(_share(p < BASS_BELOW, p)).alias("ImportanceOfBassRegister"),
        r6(_share((p >= BASS_BELOW) & (p <= HIGH_ABOVE), p)).alias("ImportanceOfMiddleRegister"),
        r6(_share(p > HIGH_ABOVE, p)).alias("ImportanceOfHighRegister"))


def duration_features(notes: DataFrame, piece: str = "piece_id") -> DataFrame:
    """M8: density, duration statistics, staccato share and total duration."""
    d = F.col("dur")
    total = F.max(F.col("onset") + d)
    return notes.groupBy(piece).agg(
        r6(F.try_divide(F.count(F.lit(1)), total)).alias("NoteDensity"),
        r6(F.avg(d)).alias("AverageNoteDuration"), r6(F.stddev_pop(d)).alias("VariabilityOfNoteDuration"),
        r6(F.max(d)).alias("MaximumNoteDuration"), r6(F.min(d)).alias("MinimumNoteDuration"),
        r6(_share(d < STACCATO_BELOW_S, d)).alias("StaccatoIncidence"), r6(total).alias("Duration"))


def quarter_length_features(notes: DataFrame, piece: str = "piece_id") -> DataFrame:
    """Distinct quarter lengths, the most common one, its share, range."""
    t = top_two(notes.select(piece, "ql"), piece, "ql", "NoteQuarterLength")
    rng = notes.groupBy(piece).agg((F.max("ql") - F.min("ql")).alias("RangeOfNoteQuarterLengths"))
    return t.select(piece, F.col("NoteQuarterLengthVariety").alias("UniqueNoteQuarterLengths"),
                    "MostCommonNoteQuarterLength", "MostCommonNoteQuarterLengthPrevalence").join(rng, piece)


def measure_pitch_weights(notes: DataFrame, piece: str = "piece_id", measure: str = "measure",
                          top: int = 4) -> DataFrame:
    """Duration-weighted pitch counts per measure, the measure's lowest
    note, and its ``top`` strongest pitches (weight desc, pitch asc)."""
    g = [piece, measure]
    wts = notes.groupBy(*g, "pitch").agg(F.sum("dur").alias("weight"))
    w = Window.partitionBy(*g).orderBy(F.col("weight").desc(), "pitch")
    low = F.min("pitch").over(Window.partitionBy(*g))
    return (wts.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("lowest", low)
            .filter(F.col("rank") <= top).withColumn("weight", r6("weight")))


# ---------------------------------------------------------------- fixed values
# Published key profiles (Krumhansl & Kessler), pitch class 0 = tonic.
KK_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
KK_MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
# Chord types as root-relative pitch-class sets.
CHORDS = {
    "MajorTriad": [0, 4, 7], "MinorTriad": [0, 3, 7], "DiminishedTriad": [0, 3, 6], "AugmentedTriad": [0, 4, 8],
    "DominantSeventh": [0, 4, 7, 10], "DiminishedSeventh": [0, 3, 6, 9],
}
# --------------------------------------------------------------------------------


def interval_histogram(iv: DataFrame, piece: str = "piece_id") -> DataFrame:
    """M2 histogram: count and share of every absolute melodic interval."""
    a = iv.filter(F.col("delta").isNotNull()).select(piece, F.abs("delta").alias("interval"))
    h = a.groupBy(piece, "interval").agg(F.count(F.lit(1)).alias("count"))
    return h.withColumn("share", r6(F.col("count") / F.sum("count").over(Window.partitionBy(piece))))


def interval_features(iv: DataFrame, piece: str = "piece_id") -> DataFrame:
    """M2: most common melodic interval, its share, the distance to and the
    relative strength of the second, and the number of common intervals."""
    a = iv.filter(F.col("delta").isNotNull()).select(piece, F.abs("delta").alias("v"))
    t = top_two(a, piece, "v", "X")
    return t.select(piece, F.col("MostCommonX").alias("MostCommonMelodicInterval"),
                    F.col("MostCommonXPrevalence").alias("MostCommonMelodicIntervalPrevalence"),
                    F.col("IntervalBetweenStrongestXs").alias("DistanceBetweenMostCommonMelodicIntervals"),
                    F.col("RelativeStrengthOfTopXs").alias("RelativeStrengthOfMostCommonIntervals"),
                    F.col("NumberOfCommonXs").alias("NumberOfCommonMelodicIntervals"))


def melodic_arcs(iv: DataFrame, piece: str = "piece_id", part: str = "part",
                 order: Sequence[str] = ("onset", "note_id")) -> DataFrame:
    """M4: an arc is a run of same-direction (non-zero) intervals of one part,
    between a turning point and the next; DurationOfMelodicArcs = mean
    intervals per arc, SizeOfMelodicArcs = mean semitones spanned."""
    d = iv.filter(F.col("delta").isNotNull() & (F.col("delta") != 0)).withColumn("_sg", F.signum("delta"))
    d = segmented_scan(d, [piece, part], order, F.floor(F.col(order[0]) / SPAN), {"_was": ("last_before", F.col("_sg"))})
    # Steps of one arc have one sign: the sizes of its steps add up to its size.
    begins = F.count(F.when(F.col("_was").isNull() | (F.col("_was") != F.col("_sg")), 1))
    return d.groupBy(piece).agg(r6(F.count(F.lit(1)) / begins).alias("DurationOfMelodicArcs"),
                                r6(F.sum(F.abs("delta")) / begins).alias("SizeOfMelodicArcs"))


def attack_spacing(notes: DataFrame, piece: str = "piece_id", part: str = "part") -> DataFrame:
    """M9: mean / population std of the time between distinct attacks, for the
    whole piece and per voice (then averaged over voices)."""
    def gaps(keys):
        o = notes.select(*keys, "onset").distinct()
        o = segmented_scan(o, keys, ["onset"], F.floor(F.col("onset") / SPAN), {"_p": ("last_before", F.col("onset"))})
        return o.select(*keys, (F.col("onset") - F.col("_p")).alias("_g")).filter(F.col("_g").isNotNull())
    whole = gaps([piece]).groupBy(piece).agg(r6(F.avg("_g")).alias("AverageTimeBetweenAttacks"),
                                             r6(F.stddev_pop("_g")).alias("VariabilityOfTimeBetweenAttacks"))
    voice = (gaps([piece, part]).groupBy(piece, part).agg(F.avg("_g").alias("_a"), F.stddev_pop("_g").alias("_s"))
             .groupBy(piece).agg(r6(F.avg("_a")).alias("AverageTimeBetweenAttacksForEachVoice"),
                                 r6(F.avg("_s")).alias("AverageVariabilityOfTimeBetweenAttacksForEachVoice")))
    return whole.join(voice, piece, "full")


def voice_counts(notes: DataFrame, piece: str = "piece_id", part: str = "part") -> DataFrame:
    """Number of parts sounding at once.  A part's sounding span begins
    at a note after the end of all its notes before, which is where the span
    before ended; spans give +1 / -1 events, netted per time, and a running sum
    gives the voice count between events: maximum, time-weighted mean and
    time-weighted std."""
    end = F.col("onset") + F.col("dur")
    n = segmented_scan(notes, [piece, part], ["onset", "note_id"], F.floor(F.col("onset") / SPAN),
                       {"_until": ("max_before", end)})
    begins = n.filter(F.col("_until").isNull() | (F.col("onset") > F.col("_until")))
    event = [F.struct(F.col("onset").alias("t"), F.lit(1).alias("d")),
             F.struct(F.col("_until").alias("t"), F.lit(-1).alias("d"))]
    ev = begins.select(piece, F.explode(F.array(*event)).alias("_x")).filter(F.col("_x.t").isNotNull())
    last = notes.groupBy(piece, part).agg(F.max(end).alias("t")).select(
        piece, F.struct("t", F.lit(-1).alias("d")).alias("_x"))
    net = ev.unionByName(last).groupBy(piece, F.col("_x.t").alias("t")).agg(F.sum("_x.d").alias("_d"))
    steps = segmented_scan(net, [piece], ["t"], F.floor(F.col("t") / SPAN),
                           {"_run": ("sum", F.col("_d")), "_from": ("last_before", F.col("t"))})
    steps = steps.select(piece, (F.col("_run") - F.col("_d")).alias("_v"), (F.col("t") - F.col("_from")).alias("_len"))
    steps = steps.filter(F.col("_len").isNotNull())
    means = steps.groupBy(piece).agg((F.sum(F.col("_v") * F.col("_len")) / F.sum("_len")).alias("_m"))
    return steps.join(means, piece).groupBy(piece).agg(
        F.max("_v").alias("MaximumNumberOfIndependentVoices"), r6(F.max("_m")).alias("AverageNumberOfIndependentVoices"),
        r6(F.sqrt(F.sum(F.col("_len") * (F.col("_v") - F.col("_m")) ** 2) / F.sum("_len")))
        .alias("VariabilityOfNumberOfIndependentVoices"))


def meter_features(meta: DataFrame, piece: str = "piece_id") -> DataFrame:
    """M11 over meta events ``(piece, onset, event_id, kind, bpm, num, den)``:
    first tempo, first time signature (num / den, null on a zero
    denominator), compound (num >= 6 and divisible by 3), triple (num = 3),
    quintuple (num = 5) and whether the signature ever changes."""
    order = F.struct("onset", "event_id")
    tempo, sign = F.col("kind") == "tempo", F.col("kind") == "timesig"
    pair = F.when(sign, F.struct("num", "den"))
    known = F.when(F.col("num").isNotNull() & F.col("den").isNotNull(), pair)
    one = meta.filter(tempo | sign).groupBy(piece).agg(
        F.min_by("bpm", F.when(tempo, order)).alias("_bpm"), F.min_by(pair, F.when(sign, order)).alias("_f"),
        # more than one known signature: the least is not the greatest
        (F.min(known) != F.max(known)).alias("_k"), F.count(F.when(sign, 1)).alias("_s"))
    num, den, some = F.col("_f.num"), F.col("_f.den"), F.col("_s") > 0
    return one.select(
        piece, F.col("_bpm").alias("InitialTempo"),
        r6(F.try_divide(num.cast("double"), den.cast("double"))).alias("InitialTimeSignature"),
        F.when(some, F.when((num >= 6) & (num % 3 == 0), 1).otherwise(0)).alias("CompoundOrSimpleMeter"),
        F.when(some, F.when(num == 3, 1).otherwise(0)).alias("TripleMeter"),
        F.when(some, F.when(num == 5, 1).otherwise(0)).alias("QuintupleMeter"),
        F.when(some, F.when(F.col("_k"), 1).otherwise(0)).alias("ChangesOfMeter"))


def _tclass(pcs: Column) -> Column:
    """Transposition class: smallest sorted transposition of a pitch-class set."""
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(11)),
                                   lambda t: F.array_sort(F.transform(pcs, lambda p: F.pmod(p + t, F.lit(12))))))


def _set_class(pcs: Column) -> Column:
    """Set class: smallest of the transposition classes of the set and its inversion."""
    inv = F.transform(pcs, lambda p: F.pmod(-p, F.lit(12)))
    return F.array_min(F.array(_tclass(pcs), _tclass(inv)))


def simultaneities(notes: DataFrame, slice_col: str, piece: str = "piece_id") -> DataFrame:
    """M13 / M14 input: the sorted pitch-class set of every slice with its set
    class and transposition class.  A set is gathered as bits of a number: a
    hash aggregate with a fixed-width buffer, combined in the map tasks, where
    sets as objects would be sorted with all their notes."""
    n = notes.withColumn("_pc", F.pmod("pitch", F.lit(12)))
    s = n.groupBy(piece, slice_col).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_pc").cast("int"))).alias("_bits"))
    bits = F.coalesce("_bits", F.lit(0))
    pcs = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda p: F.getbit(bits, p) == 1)
    s = s.select(piece, slice_col, pcs.cast(f"array<{n.schema['_pc'].dataType.simpleString()}>").alias("pcs"))
    return s.withColumn("set_class", _set_class(F.col("pcs"))).withColumn("t_class", _tclass(F.col("pcs")))


def simultaneity_features(sl: DataFrame, piece: str = "piece_id") -> DataFrame:
    """M13 + M14 from :func:`simultaneities`.  Slices are counted per set
    first; the classes are made once per set of a piece, and one chain of
    aggregates on the pieces' partitioning gives all features."""
    sets = sl.where(F.col(piece).isNotNull()).groupBy(piece, "pcs").agg(F.count(F.lit(1)).alias("_c"))
    c = F.col("_c")
    # transposition classes of the chord types (constant-folded by Catalyst)
    classes = {name: _tclass(F.array(*[F.lit(x) for x in v])) for name, v in CHORDS.items()}
    tc = F.col("_tc")
    chords = {n: tc == classes[n] for n in ("MajorTriad", "MinorTriad", "DominantSeventh", "DiminishedTriad",
                                            "DiminishedSeventh")}
    chords["Triad"] = tc.isin(*[classes[n] for n in ("MajorTriad", "MinorTriad", "DiminishedTriad", "AugmentedTriad")])
    kinds = (sets.select(piece, "_c", _set_class(F.col("pcs")).alias("_sc"), _tclass(F.col("pcs")).alias("_tc"))
             .groupBy(piece, "_sc")
             .agg(F.count(F.lit(1)).alias("_u"), F.max(c).alias("_m"), F.sum(c).alias("_n"),
                  *[F.sum(F.when(cond, c).otherwise(0)).alias(f"_{n}") for n, cond in chords.items()]))
    total = F.sum("_n")
    return kinds.groupBy(piece).agg(
        F.sum("_u").alias("UniquePitchClassSetSimultaneities"),
        r6(F.max("_m") / total).alias("MostCommonPitchClassSetSimultaneityPrevalence"),
        F.count(F.lit(1)).alias("UniqueSetClassSimultaneities"),
        r6(F.max("_n") / total).alias("MostCommonSetClassSimultaneityPrevalence"),
        *[r6(F.sum(f"_{n}") / total).alias(f"{n}SimultaneityPrevalence") for n in chords])


def key_profile_table(spark) -> DataFrame:
    """The 24 keys x 12 pitch classes profile table (288 rows, built by rotation)."""
    rows = [(mode * 12 + tonic, mode, tonic, pc, prof[(pc - tonic) % 12])
            for mode, prof in enumerate((KK_MAJOR, KK_MINOR)) for tonic in range(12) for pc in range(12)]
    return spark.createDataFrame(rows, "key int, mode int, tonic int, pc int, weight double")


def key_features(notes: DataFrame, piece: str = "piece_id") -> DataFrame:
    """Duration per pitch class (12 bins, 0 when absent) correlated with
    the 24 rotated key profiles (a fixed 288-row table, broadcast); the best
    key (ties to the lowest key id) gives QualityFeature (0 major, 1 minor)
    and TonalCertainty (its correlation)."""
    bins = notes.groupBy(piece, F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.sum("dur").alias("_d"))
    grid = notes.select(piece).distinct().withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11))))
    vec = grid.join(bins, [piece, "pc"], "left").fillna(0.0, subset=["_d"])
    prof = F.broadcast(key_profile_table(notes.sparkSession))
    c = vec.join(prof, "pc").groupBy(piece, "key", "mode").agg(F.corr("_d", "weight").alias("_r"))
    best = c.filter(F.col("_r").isNotNull()).groupBy(piece).agg(
        F.max_by(F.struct("mode", "_r"), F.struct(F.col("_r"), -F.col("key"))).alias("_b"))
    return best.select(piece, F.col("_b.mode").alias("QualityFeature"), r6("_b._r").alias("TonalCertainty"))


def feature_source(name: str) -> str | None:
    """Column of the M operators that feeds a symbolic feature name (None for
    the names that are not built: they stay null columns)."""
    from reelforge.functions.names import SYMBOLIC_NOT_BUILT
    if name in SYMBOLIC_NOT_BUILT:
        return None
    if name.endswith("Feature") and name != "QualityFeature":
        return name[: -len("Feature")]
    return name
