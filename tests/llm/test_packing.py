import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD_TEXTS, documents, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelforge.llm import packing, tokens

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_cached_ids_equal_the_tokenizer(texts):
    enc = tokens.encoder(tokens.vocabulary_path())
    texts = texts + ["a <|endoftext|> b", " \x1c\x85\xa0 x\n\n y's", " ", "", " a b ", "b's  c", "a\nb c.d", "y" * 300]
    assert [x.tolist() for x in enc.encode(texts)] == [ids_of(t) for t in texts]


def test_cache_has_a_bound(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    enc = tokens.Encoder(tokens.vocabulary_path())
    for i in range(20):
        texts = [words(40, i, 10**6), words(10, 1)]
        assert [x.tolist() for x in enc.encode(texts)] == [ids_of(t) for t in texts]
    assert len(enc.number) == 50 and enc.used == enc.begin[49] + enc.size[49]


def unpacked(rows, whole, tokens=2048):
    """Checks the pieces and returns the padding."""
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(whole)
    for k, pieces in by.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            ids = whole[k][at:at + p["length"]]
            assert p["start"] == at and p["length"] == len(ids) > 0 and p["doc_tokens"] == len(whole[k])
            assert p["ids"] == np.array(ids, "<u4").tobytes()
            at += p["length"]
        assert at == len(whole[k])
    padding = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= tokens
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_documents_round_trip_without_padding(spark):
    texts = ODD_TEXTS + [words(5 + i % 300, i) for i in range(300)]
    df = documents(spark, texts, extra=True).repartition(3)
    rows = [r.asDict() | {"id": r.doc_id} for r in packing.packed_documents(df).collect()]
    assert unpacked(rows, {i: ids_of(t) + [1] for i, t in enumerate(texts)}) == 0
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= total // 2048 + 3 * 12


def test_all_limits_hold_at_once(spark):
    rng = random.Random(3)
    examples = [(i, [(words(rng.randrange(1, 120), i), False), (words(rng.randrange(1, 60), -i), True)])
                for i in range(200)] + [(900, None), (901, []), (902, [(None, None)]), (903, [None])]
    df = spark.createDataFrame(examples, "id long, parts array<struct<text:string,loss:boolean>>")
    limits = packing.Limits(tokens=512, segments=6, loss=200)
    rows = [r.asDict() for r in packing.packed(df.coalesce(1), "id", "parts", limits).collect()]
    whole, loss = {}, {}
    for k, parts in examples:
        parts = [p or ("", False) for p in parts or []]
        ids = [ids_of(t) for t, _ in parts]
        whole[k] = sum(ids, []) + [1]
        loss[k] = sum(([bool(f)] * len(x) for x, (_, f) in zip(ids, parts)), []) + [bool(parts[-1][1]) if parts else True]
    unpacked(rows, whole, 512)
    seqs = {}
    for r in rows:
        assert r["loss_tokens"] == sum(loss[r["id"]][r["start"]:r["start"] + r["length"]])
        seqs.setdefault(r["sequence_id"], []).append(r)
    for pieces in seqs.values():
        assert len(pieces) <= 6 and sum(p["loss_tokens"] for p in pieces) <= 200
        assert sum(p["length"] for p in pieces) <= 512


def test_dot_product_choice():
    """With half of the tokens and all of the loss left, the loss-heavy piece fits best."""
    packer = packing.Packer(packing.Limits(100, 10, 50))
    def piece(name, n, loss):
        return packing.Piece(name, n, 0, np.zeros(n, np.uint32), np.concatenate([[0], np.cumsum(np.arange(n) < loss)]))
    for p in (piece("a", 60, 0), piece("b", 40, 40), piece("c", 40, 0)):
        packer._pend(p)
    assert [p.example for p in packer._fill()] == ["b", "a"]


def test_repeated_rows_null_ids_empty_table_and_reruns(spark):
    df = documents(spark, [words(30)] * 4 + [None], ids=[1, 1, 1, None, None])
    rows = packing.packed_documents(df.coalesce(1)).collect()
    per = {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    one = len(ids_of(words(30))) + 1
    assert per == {1: 3 * one, None: one + 1}
    assert packing.packed_documents(df.limit(0)).collect() == []
    assert sorted(map(str, rows)) == sorted(map(str, packing.packed_documents(df.coalesce(1)).collect()))


def test_crc_matches_zlib(spark):
    from pyspark.sql import functions as F
    r = packing.packed_documents(documents(spark, ["hello world"])).select("ids", F.crc32("ids").alias("c")).collect()
    assert all(x.c == zlib.crc32(x.ids) for x in r)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 2047, 2048])
def test_powers_of_two(n):
    p = packing.Piece(0, n, 0, np.arange(n, dtype=np.uint32), np.arange(n + 1))
    parts = list(packing.at_powers_of_two([p], 2048))
    sizes = [sum(len(x.ids) for x in s) for s in parts]
    assert sum(sizes) == n and all(s & (s - 1) == 0 for s in sizes)
