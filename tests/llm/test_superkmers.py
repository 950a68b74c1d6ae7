"""Repeated windows against a dictionary of all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from helpers import ODD_TEXTS, WORD, documents, words, write
from reelforge.llm import q_superkmers, superkmers


def brute(ids, texts, window=13):
    split = [WORD.findall(t or "") for t in texts]
    order = [float("inf") if i is None else i for i in ids]
    least = {}
    for own, ws in zip(order, split):
        for i in range(len(ws) - window + 1):
            run = tuple(ws[i:i + window])
            least[run] = min(least.get(run, own), own)
    out = []
    for i, own, ws in zip(ids, order, split):
        keep = [True] * len(ws)
        for j in range(len(ws) - window + 1):
            if least[tuple(ws[j:j + window])] < own:
                keep[j:j + window] = [False] * window
        kept = [w for w, k in zip(ws, keep) if k]
        out.append((i, len(ws), len(ws) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return collections.Counter(out)


def check(spark, texts, ids=None, window=13, extra=False, **kind):
    docs = documents(spark, texts, extra=extra, ids=ids)
    rows = superkmers.without_repeats(docs, window=window, **kind).collect()
    got = collections.Counter((r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == brute(ids or list(range(len(texts))), texts, window)


def mixed(seed, n):
    rnd = random.Random(seed)
    passages = [words(rnd.randrange(10, 70), 1000 + k) for k in range(6)]
    out = []
    for i in range(n):
        parts = [words(rnd.randrange(0, 40), seed * 100 + i)]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), words(rnd.randrange(0, 30), seed * 1000 + i)]
        out.append(rnd.choice([" ", "\n", " \t "]).join(parts))
    return out


def test_equals_a_dictionary_of_windows(spark):
    check(spark, ODD_TEXTS + mixed(1, 150) + ["a " * 400, "a " * 300, "a b " * 200, "x a " * 90], extra=True)


@pytest.mark.parametrize("window, core", [(13, 1), (8, 3), (5, 5), (2, 1), (16, 4)])
def test_other_windows_and_cores(spark, window, core):
    check(spark, mixed(window, 60) + ["a b a b a b a b a b", "b a b a"], window=window, core=core)


def test_repeated_ids_null_ids_and_copies(spark):
    texts = mixed(3, 40) * 3
    rnd = random.Random(5)
    ids = [rnd.choice([None, *range(25)]) for _ in texts]
    check(spark, texts, ids=ids)


def test_one_passage_in_all_documents_is_dealt_window_by_window(spark, monkeypatch):
    hot = words(60, 77)
    texts = [f"{words(15, i)} {hot} {words(15, 500 + i)}" for i in range(300)]
    docs = documents(spark, texts)
    counts = superkmers.bucket_words(superkmers._texts(docs, "doc_id", "text"), 13, 3, 512).collect()
    mean = sum(r.words for r in counts) / 512
    assert any(r.words > superkmers.CROWDED * mean for r in counts)
    check(spark, texts, bucket_bytes=300)  # some five hundred buckets


def test_flushes_and_long_texts(spark, monkeypatch):
    # Settings are read in the workers' module copies, so the parts are called here.
    import pyarrow as pa
    monkeypatch.setattr(superkmers, "STEP", 100)
    text = words(950, 4)
    seen = []
    for lo, data, starts, ends, rows, offset, begin in superkmers._chunks(pa.array([None, "a b", text, text]), 13):
        first, _ = superkmers.window_minimisers(superkmers.span_hash(data, starts, ends), rows, 13, 3)
        seen += [(int(rows[i]), int(i + offset - begin[rows[i]])) for i in first]
    assert sorted(seen) == [(r, i) for r in (2, 3) for i in range(938)]


def test_numbers_of_runs_are_exact():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 3, 4000)
    for window in (2, 3, 5, 8, 13):
        numbers = superkmers.window_numbers(codes.astype(np.int64), window)
        runs = {}
        for i, n in enumerate(numbers.tolist()):
            assert runs.setdefault(tuple(codes[i:i + window]), n) == n
        assert len(set(runs.values())) == len(runs)


def test_empty_table_and_query(spark, scratch, tmp_path):
    write(documents(spark, []), scratch, "documents")
    assert q_superkmers.op12_substring_dedup(spark, scratch).count() == 0
    texts, folder = ODD_TEXTS + mixed(9, 60), str(tmp_path / "some")
    write(documents(spark, texts, extra=True), folder, "documents")
    got = collections.Counter(tuple(r) for r in q_superkmers.op12_substring_dedup(spark, folder).collect())
    assert got == brute(list(range(len(texts))), texts)
