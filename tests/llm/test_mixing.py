import math
from collections import defaultdict

import pytest

from helpers import ODD_TEXTS, WORD, documents, words
from pyspark.sql import functions as F

from reelforge.llm import mixing


def targets(sizes):
    """Water filling as a loop: reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= full
    return out


def rows_of(df):
    return mixing.curriculum(df).select("*", F.col("_mx_turns.position").alias("p"),
                                        F.col("_mx_turns.words").alias("w")).collect()


def test_targets_and_taken(spark):
    texts = [words(20 + 7 * i % 90, i) for i in range(150)]
    sources = [None if i % 10 == 9 else "hot" if i % 3 == 0 else f"s{i % 7}" for i in range(150)]
    rows = rows_of(documents(spark, texts, sources=sources))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["_mx_size"] == len(WORD.findall(r.text))
        assert sum(r.w) <= 2 * r["_mx_size"]
        sizes[r.source] += r["_mx_size"]
        taken[r.source] += sum(r.w)
        target[r.source] = r["_mx_target"]
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == round(target[s])
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = {(r.doc_id, tuple(r.w), tuple(r.p)) for r in rows_of(documents(spark, texts[::-1], sources=sources[::-1],
                                                                         ids=list(range(150))[::-1]))}
    assert again == {(r.doc_id, tuple(r.w), tuple(r.p)) for r in rows}


def test_positions_invert_the_demand(spark):
    for knots in mixing.SCHEDULES:
        whole = mixing.integral(knots)
        parts = [i / 50 for i in range(51)]
        got = spark.createDataFrame([(p,) for p in parts], "p double").select(
            mixing.time_of(knots, F.col("p")).alias("t")).collect()
        for p, r in zip(parts, got):
            steps = 20000
            area = sum(weight(knots, (i + 0.5) * r.t / steps) for i in range(steps)) * r.t / steps
            assert area == pytest.approx(p * whole, abs=1e-4)


def weight(knots, t):
    for (a, x), (b, y) in zip(knots, knots[1:]):
        if t <= b:
            return x + (y - x) * (t - a) / (b - a)
    return knots[-1][1]


def test_training_order_and_whole_documents(spark):
    df = documents(spark, [words(10 + i % 40, i) for i in range(200)], extra=True)
    mixed = mixing.curriculum(df, cut=False)
    assert all(set(r.w) <= {r["_mx_size"]} for r in mixed.select("_mx_size", F.col("_mx_turns.words").alias("w")).collect())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    times = {r.doc_id: sorted(r.p) for r in mixed.select("doc_id", F.col("_mx_turns.position").alias("p")).collect()}
    seen, last = defaultdict(int), -1.0
    for r in out.collect():
        t = times[r.doc_id][seen[r.doc_id]]
        seen[r.doc_id] += 1
        assert t >= last
        last = t
    assert {k: len(v) for k, v in times.items() if v} == dict(seen)


def test_odd_rows_and_empty_tables(spark):
    df = documents(spark, ODD_TEXTS + [words(9)] * 3, extra=True, ids=[None] + list(range(11)) + [5, 5, 5])
    rows = rows_of(df)
    assert len(rows) == 15
    assert all((r["_mx_size"] == 0) == (not WORD.findall(r.text or "")) for r in rows)
    assert all(not r.w for r in rows if r["_mx_size"] == 0)
    assert rows_of(df.limit(0)) == [] and mixing.mixed_documents(df.limit(0)).collect() == []
    assert rows_of(documents(spark, [None, "", " "]))[0]["_mx_target"] == 0


def test_sources_without_words_and_one_source(spark):
    rows = rows_of(documents(spark, ["", "a b", "c d e"], sources=["empty", "one", "one"]))
    assert {r.source: r["_mx_target"] for r in rows} == {"empty": 0, "one": 7.5}
    assert math.isclose(sum(sum(r.w) for r in rows), 8)
