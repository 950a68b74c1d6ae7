import collections
import math

import numpy as np
import pytest
from helpers import ODD_TEXTS, crc_fold, documents, words, write

from pyspark.sql import functions as F

from reelforge.llm import ppm
from reelforge.llm.common import fold, shared_folder
from reelforge.llm.q_ppm import op2_lm_scoring


def sequence(text):
    return bytes([ppm.END]) * ppm.ORDER + b" ".join((text or "").encode().lower().split()) + bytes([ppm.END])


def brute(ids, texts, training):
    """Scores from one dictionary trie and one counter."""
    counts, trie = collections.Counter(), ppm.Trie()
    for i, t in zip(ids, texts):
        if training(i):
            counts.update((t or "").encode().lower().split() + [None])
            s = sequence(t)
            for j in range(ppm.ORDER, len(s)):
                trie.learn(s[j - ppm.ORDER:j], s[j])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in zip(ids, texts):
        w = (t or "").encode().lower().split() + [None]
        out.append((i, training(i), len(w), sum(counts[x] > 0 for x in w), n,
                    sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w),
                    ppm.adaptive_score(t, trie, learn=False)))
    return out


def same(rows, want):
    rows, want = sorted(rows, key=str), sorted(want, key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    for r, w in zip(rows, want):
        assert r[5] == pytest.approx(w[5], abs=1e-6) and r[6] == pytest.approx(w[6], abs=1e-6)


TEXTS = ODD_TEXTS + [words(9_000, 5), "y" * 70_000 + " z " + "y" * 70_000] + [words(5 + 3 * i, i, 80).title() for i in range(60)]


@pytest.mark.parametrize("block_bytes", [48 << 20, 700])
def test_scores_match_a_trie(spark, scratch, monkeypatch, block_bytes):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", block_bytes)
    df = documents(spark, TEXTS, extra=True).repartition(3)
    ids = list(range(len(TEXTS)))
    write(df, scratch, "documents")
    got = op2_lm_scoring(spark, scratch).collect()
    want = brute(ids, TEXTS, lambda i: crc_fold(i) != 1)
    same([(r.doc_id, not r.held_out, *tuple(r)[2:]) for r in got], want)


def test_frames_not_read_from_files_null_ids_and_repeats(spark):
    ids = [None, 1, 1, 2, None]
    texts = ["a b", "a b", "c", None, "d é"]
    df = documents(spark, texts, extra=True, ids=ids)
    got = ppm.pretrained_scores(df, fold(F.col("doc_id"), 5) != 1, shared_folder(spark, "t")).collect()
    same([tuple(r) for r in got], brute(ids, texts, lambda i: crc_fold(i) != 1))


def test_nothing_to_learn_from_and_empty_table(spark):
    df = documents(spark, ["abc", None])
    rows = {r.id: r for r in ppm.pretrained_scores(df, F.lit(False), shared_folder(spark, "t")).collect()}
    assert rows[0].score == pytest.approx(-4 * math.log10(256)) and rows[1].score == pytest.approx(-math.log10(256))
    assert rows[0].base_score == 0 and rows[0].n_known == 0 and rows[0].train_tokens == 0
    assert ppm.pretrained_scores(df.limit(0), F.lit(True), shared_folder(spark, "t")).collect() == []


def test_probabilities_add_up_to_one():
    trie = ppm.Trie()
    s = sequence("the cat sat on the mat the cat")
    for j in range(ppm.ORDER, len(s)):
        trie.learn(s[j - ppm.ORDER:j], s[j])
    for context in (s[:ppm.ORDER], b"e cat", b"zzzzz", b"at sa", b" the "):
        assert sum(10 ** trie.log10(context, x) for x in range(256)) == pytest.approx(1)


def block(texts):
    import pyarrow as pa
    return next(ppm._parts(pa.array(texts, pa.string())))[2]


def grams(texts):
    return next(block(texts).grams())[:2]


def test_parts_of_long_texts_equal_the_whole(monkeypatch):
    texts = ["", words(3000, 1), " a\n\nb ", words(900, 2) + " " + "q" * 3000 + " end ", None, "x" * 5000]
    for t in texts:
        s = sequence(t)
        want = [int.from_bytes(s[i:i + ppm.ORDER + 1]) for i in range(len(s) - ppm.ORDER)]
        tokens = (t or "").encode().lower().split()
        for size, longest in ((1 << 19, 1 << 16), (100, 50)):
            monkeypatch.setattr(ppm, "SLICE", size)
            monkeypatch.setattr(ppm, "LONG_WORD", longest)
            one = block([t])
            assert np.concatenate([k for k, _, _ in one.grams()]).tolist() == want
            keys = np.concatenate([k for k, _, _ in one.words()]).tolist()
            assert len(keys) == len(tokens) + 1 == one.n_tokens[0]
            again = {}
            assert all(again.setdefault(w, k) == k for w, k in zip(tokens, keys))
            assert len(set(again.values())) == len(again)


def test_a_text_of_many_megabytes_stays_within_memory():
    import resource
    text = (words(1000, 6) + "\n") * 4000  # some 20 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    counts = ppm.Counts()
    for keys, _, _ in block([text]).grams():
        counts.add(keys)
    assert counts.merged()[1].sum() == len(sequence(text)) - ppm.ORDER
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700 << 10


def test_model_predicts_held_out_text_of_its_kind():
    keys, _ = grams([words(400, i, 60) for i in range(30)])
    held, first = grams([words(300, 77, 60), words(300, 3, 60).upper()[::-1]])
    u, at = np.unique(np.concatenate([keys, held]), return_inverse=True)
    n = np.bincount(at[:len(keys)], minlength=len(u)).astype(float)
    pairs = np.zeros((256, 256))
    np.add.at(pairs, ((keys >> 8) & 255, keys & 255), 1)
    two, count = np.unique(keys & 0xFFFFFF, return_counts=True)
    second = sorted((int(c << 8 | t & 255), int(m)) for c in np.unique((u >> 8) & 0xFFFFFF)
                    for t, m in zip(two, count) if t >> 8 == c & 0xFFFF)
    second = np.array([x for x, _ in second]), np.array([m for _, m in second], float)
    value = ppm.log_probabilities(u, n, second, pairs)[at[len(keys):]]
    like, unlike = np.add.reduceat(value, first) / np.diff(np.append(first, len(held)))
    assert like > -0.6 and unlike < like - 0.3


def test_adaptive_mode(spark):
    texts = [None, "", "ab" * 200, words(60), "é"]
    got = {r.id: r.score for r in ppm.adaptive_scores(documents(spark, texts, extra=True)).collect()}
    assert got == {i: ppm.adaptive_score(t) for i, t in enumerate(texts)}
    assert got[2] / 400 > got[3] / len(texts[3])  # repetition is learned
