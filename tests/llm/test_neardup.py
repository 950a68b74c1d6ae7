import random
import re

import pytest
from helpers import ODD_TEXTS, documents, words

from reelforge.llm import neardup
from reelforge.llm.common import shared_folder
from reelforge.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(texts, ids):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    out = []
    for i, k in enumerate(ids):
        own = [ids[j] for j in range(len(ids)) if root(j) == root(i) and ids[j] is not None]
        out.append((k, len(sets[i]), min(own, default=None)))
    return sorted(out, key=str)


def found(df):
    rows = neardup.near_duplicates(df, shared_folder(df.sparkSession, "t")).collect()
    return sorted(((r.id, r.n_shingles, r.component) for r in rows), key=str)


def edit(text, rate, rng):
    return " ".join(f"e{rng.random()}" if rng.random() < rate else w for w in text.split())


def corpus():
    """Copies, near copies at all distances, shared passages, short texts."""
    rng = random.Random(4)
    passage = words(60, 99, 10**6)
    texts = list(ODD_TEXTS)
    for g in range(12):
        base = words(rng.choice([8, 30, 90, 200, 400]), 100 + g, 10**6)
        texts += [base, base.upper()] + [edit(base, rate, rng) for rate in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    texts += [words(40, 500 + i, 10**6) + " " + passage for i in range(30)]
    texts += ["a b c", "A  b\nc", "a b c d", "a b c d e", "a b c d e"]
    return texts


def test_components_match_brute_force(spark):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    assert found(documents(spark, texts, extra=True, ids=ids)) == brute(texts, ids)


def test_chain_of_near_copies_and_long_lists(spark, monkeypatch):
    # A family whose ends are not similar, more members than a block.
    monkeypatch.setattr(neardup, "SHORT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, base = random.Random(2), words(100, 7, 10**6).split()
    texts = []
    for i in range(60):
        base = list(base)
        base[rng.randrange(100)] = f"z{i}"
        texts.append(" ".join(base))
    start = words(100, 7, 10**6)
    texts += [edit(start, 0.06, rng) for _ in range(60)]
    ids = list(range(len(texts)))
    assert found(documents(spark, texts)) == brute(texts, ids)


def test_block_comparison_alone_finds_every_link(spark, monkeypatch):
    """Without the star rounds the last stage must still find all components."""
    monkeypatch.setattr(neardup, "SHORT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    star = neardup.star_pairs
    monkeypatch.setattr(neardup, "star_pairs", lambda lists, order: star(lists, order).limit(0))
    texts = corpus()
    assert found(documents(spark, texts)) == brute(texts, list(range(len(texts))))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    texts = [words(50)] * 3 + [words(50, 2)] * 2 + [None, "", words(50)]
    ids = [4, 4, None, None, None, 3, None, 9]
    assert found(documents(spark, texts, ids=ids)) == brute(texts, ids)
    df = documents(spark, texts, extra=True, ids=ids)
    kept = neardup.one_of_each(df, shared_folder(spark, "t"))
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.text and r.doc_id is not None) == [(4, words(50))]
    assert sorted(str(r.text) for r in rows) == sorted(["None", "", words(50), words(50, 2)])
    assert found(df.limit(0)) == [] and neardup.one_of_each(df.limit(0), shared_folder(spark, "t")).collect() == []


def test_one_of_each_keeps_the_smallest_id(spark):
    texts = corpus()
    rows = neardup.one_of_each(documents(spark, texts), shared_folder(spark, "t")).collect()
    want = {c for i, n, c in brute(texts, list(range(len(texts)))) if i == c}
    assert sorted(r.doc_id for r in rows) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)]
    df = spark.createDataFrame(links + [(5, 5), (None, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df, shared_folder(spark, "t"), "c").collect()}
    up = {x: x for ab in links for x in ab}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[x] == got[y]) == (root(x) == root(y)) for x in nodes for y in nodes)
