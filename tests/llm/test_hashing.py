import random

import pytest

from pyspark.sql import functions as F

from reelforge.llm import hashing
from reelforge.llm.common import shared_folder


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s") for i, v in rows],
                                 "vec_id long, embedding array<float>, distance int, query string")


def bits_of(v, bits):
    v = list(v)[:bits] + [0.0] * (bits - len(v))
    return [x is not None and x == x and x > 0 for x in v]


def brute(rows, asked, k, bits):
    rows = {(i, tuple(bits_of(v, bits))) for i, v in rows if i is not None and v is not None}
    out = []
    for q, a in {x for x in rows if asked(x[0])}:
        near = sorted({(sum(x != y for x, y in zip(a, b)), i) for i, b in rows})[:k]
        out += [(q, i, d, r) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def search(spark, rows, k, bits=64, asked=lambda c: c % 10 == 0):
    df = vectors(spark, rows).select(F.col("vec_id").alias("id"), hashing.code(F.col("embedding"), bits).alias("code"))
    got = hashing.nearest(df, df.where(asked(F.col("id"))), k, shared_folder(spark, "t"), bits)
    return sorted(tuple(r) for r in got.collect())


def sample(n, rng, bits=64):
    return [rng.uniform(-1, 1) for _ in range(bits)]


@pytest.mark.parametrize("bits", [64, 24])
def test_matches_brute_force(spark, bits):
    rng = random.Random(bits)
    base = [sample(bits, rng, bits) for _ in range(40)]
    rows = [(i, base[i % 40] if i % 5 else sample(bits, rng, bits)) for i in range(200)]
    for i in range(0, 200, 7):  # near codes: a few signs flipped
        v = list(base[i % 40])
        for j in rng.sample(range(bits), 4):
            v[j] = -v[j]
        rows[i] = (i, v)
    assert search(spark, rows, 5, bits) == brute(rows, lambda i: i % 10 == 0, 5, bits)


def test_hot_code_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    hot = sample(64, rng)
    rows = [(i, hot) for i in range(60)] + [(60 + i, sample(64, rng)) for i in range(40)]
    rows += [(200, None), (None, hot), (210, [None] * 64), (220, [float("nan")] * 64), (230, [1.0, 2.0]), (240, []),
             (10, hot), (10, hot)]
    assert search(spark, rows, 3) == brute(rows, lambda i: i % 10 == 0, 3, 64)


def test_fewer_rows_than_k_and_empty_table(spark):
    rng = random.Random(6)
    rows = [(i * 10, sample(64, rng)) for i in range(3)]
    assert search(spark, rows, 10, bits=16) == brute(rows, lambda i: True, 10, 16)
    df = vectors(spark, rows).select(F.col("vec_id").alias("id"), hashing.code(F.col("embedding"), 64).alias("code"))
    assert hashing.nearest(df.limit(0), df, 3, shared_folder(spark, "t")).collect() == []
    assert hashing.nearest(df, df.limit(0), 3, shared_folder(spark, "t")).collect() == []


def test_a_round_finds_its_whole_shell_once(spark):
    rng = random.Random(9)
    rows = [(i, sample(64, rng)) for i in range(120)]
    df = vectors(spark, rows).select(F.col("vec_id").alias("id"), hashing.code(F.col("embedding"), 64).alias("code"))
    postings = hashing.smallest_ids(df, 2).select("code", "ids", F.posexplode("code").alias("segment", "value"))
    active = df.where("id < 6").select(F.col("code").alias("query"))
    a = {i: bits_of(v, 64) for i, v in rows}
    apart = [sum(x != y for x, y in zip(a[i], a[j])) for i in range(6) for j in range(120)]
    for r in range(6):
        pairs = hashing.round_pairs(active, postings, r, 4).collect()
        assert sorted(p.distance for p in pairs) == sorted(d for d in apart if 4 * r - 1 < d <= 4 * r + 3)
        assert len({(tuple(p.query), tuple(p.code)) for p in pairs}) == len(pairs)
