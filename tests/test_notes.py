"""Note features with one piece that holds most notes: the one-pass table
equals the separate operators and a plain scan in Python."""

import math
import random

from pyspark.sql import functions as F

from reelforge.operators import note_table as NT
from reelforge.operators import notes as N

SCHEMA = ("piece_id int, part string, note_id int, onset double, dur double, pitch int, ql double, slice long, "
          "kind string, bpm int, num int, den int")


def _notes():
    rnd = random.Random(11)
    rows, at = [], {}
    for i in range(2400):
        piece = 0 if i % 3 else 1 + i % 7  # two thirds in one piece
        at[piece] = at.get(piece, 0.0) + rnd.choice([0.0, 0.25, 0.5, 1.0, 40.0])
        onset, dur = at[piece], rnd.choice([0.05, 0.5, 1.0, 3.0, 700.0 if i % 50 == 0 else 2.0])
        kind = rnd.choice(["tempo", "timesig", None, None])
        rows.append((piece, rnd.choice("abc"), i, onset, dur, rnd.randrange(40, 90), dur / 2, int(onset // 16), kind,
                     60 + i % 90, 2 + i % 6, rnd.choice([0, 4, 8])))
    return rows


def _scan(rows):
    """Arcs, gaps and voices of one piece, note by note."""
    steps, gaps, events, moves = [], [], [], []
    onsets = sorted({r[3] for r in rows})
    gaps = [b - a for a, b in zip(onsets, onsets[1:])]
    arcs = size = nonzero = 0
    for part in "abc":
        own = sorted((r for r in rows if r[1] == part), key=lambda r: (r[3], r[2]))
        deltas = [b[5] - a[5] for a, b in zip(own, own[1:])]
        steps += deltas
        signs = [d for d in deltas if d]
        arcs += sum(i == 0 or (signs[i] > 0) != (signs[i - 1] > 0) for i in range(len(signs)))
        size += sum(map(abs, signs))
        nonzero += len(signs)
        until = None
        for r in own:
            if until is None or r[3] > until:
                events += [(r[3], 1)] + ([(until, -1)] if until is not None else [])
            until = max(until or 0, r[3] + r[4])
        if own:
            events.append((until, -1))
    net = {}
    for t, d in events:
        net[t] = net.get(t, 0) + d
    voices, spans, times = 0, [], sorted(net)
    for a, b in zip(times, times[1:]):
        voices += net[a]
        spans.append((voices, b - a))
    total = sum(x for _, x in spans)
    mean = sum(v * x for v, x in spans) / total
    return {"AverageMelodicIntervalFeature": sum(map(abs, steps)) / len(steps),
            "DurationOfMelodicArcsFeature": nonzero / arcs, "SizeOfMelodicArcsFeature": size / arcs,
            "AverageTimeBetweenAttacksFeature": sum(gaps) / len(gaps),
            "MaximumNumberOfIndependentVoicesFeature": max(v for v, _ in spans),
            "AverageNumberOfIndependentVoicesFeature": mean,
            "VariabilityOfNumberOfIndependentVoicesFeature": math.sqrt(sum(x * (v - mean) ** 2 for v, x in spans) / total)}


def test_one_pass_equals_the_operators_and_a_scan(spark):
    rows = _notes()
    notes = spark.createDataFrame(rows, SCHEMA)
    table = {r.piece_id: r.asDict() for r in NT.symbolic_feature_table(notes).collect()}
    assert set(table) == {r[0] for r in rows}
    for piece in table:
        for name, want in _scan([r for r in rows if r[0] == piece]).items():
            assert abs(table[piece][name] - want) < 2e-6, (piece, name)
    iv = N.with_intervals(notes)
    meta = notes.where("kind IS NOT NULL").withColumnRenamed("note_id", "event_id")
    pcs = notes.select("piece_id", F.pmod("pitch", F.lit(12)).alias("v"))
    parts = [N.melodic_features(iv), N.interval_features(iv), N.melodic_arcs(iv), N.register_features(notes),
             N.duration_features(notes), N.attack_spacing(notes), N.voice_counts(notes), N.meter_features(meta),
             N.quarter_length_features(notes), N.key_features(notes),
             N.simultaneity_features(N.simultaneities(notes, "slice")),
             N.top_two(notes.select("piece_id", F.col("pitch").alias("v")), "piece_id", "v", "Pitch", "Pitches"),
             N.top_two(pcs, "piece_id", "v", "PitchClass", "PitchClasses")]
    compared = set()
    for part in parts:
        for r in part.collect():
            for column, value in r.asDict().items():
                name = next((n for n in table[r.piece_id] if N.feature_source(n) == column), None)
                if name and column != "piece_id":
                    got = table[r.piece_id][name]
                    assert (got is None) == (value is None), (r.piece_id, name)
                    assert value is None or abs(got - float(value)) < 2e-6, (r.piece_id, name, got, value)
                    compared.add(name)
    assert len(compared) == 69
