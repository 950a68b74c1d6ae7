"""Cross-tokenizer alignment against an alignment token by token."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel  # noqa: F401  (the vocabulary's own byte table is checked against it)

from helpers import ODD_TEXTS, documents, words, write
from reelforge.llm import alignment, q_alignment

MORE = ["a  b", "  a ", "tab\tnew\nline \r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁x", "\x00a",
        "é\U0001f642 中文 café", "﻿x", "ﬁ ①", "it's we're 12,345.67", words(40), words(40)]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_table():
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def brute(tools, texts):
    a, b = tools
    table, rows, held = byte_table(), [], collections.Counter()
    for t in texts:
        links, groups = [], []
        if t:
            x = a.encode(" " + t, add_special_tokens=False)
            xs = [(i, bytes(table[c] for c in s)) for i, s in zip(x.ids, x.tokens)]
            ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                   else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            plain = (" " + t).encode()
            if b"".join(s for _, s in xs) == plain == b"".join(s for _, s in ys):
                i = j = at_i = at_j = 0
                ga, gb = [], []
                new_i = new_j = True
                while i < len(xs) and j < len(ys):
                    links.append((xs[i][0], ys[j][0]))
                    if new_i:
                        ga.append(xs[i][0])
                    if new_j:
                        gb.append(ys[j][0])
                    ei, ej = at_i + len(xs[i][1]), at_j + len(ys[j][1])
                    new_i, new_j = ei <= ej, ej <= ei
                    if new_i:
                        i, at_i = i + 1, ei
                    if new_j:
                        j, at_j = j + 1, ej
                    if new_i and new_j:
                        groups.append((ga, gb))
                        ga, gb = [], []
        rows.append((links, groups))
        held.update(set(links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for links, groups in rows:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
                    sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, held


def check(spark, tools, texts, folder, **kind):
    docs = documents(spark, texts, **kind)
    found, pairs = alignment.aligned(docs, folder)
    rows = collections.Counter((r.id, *r[1:]) for r in found.collect())
    want, held = brute(tools, texts)
    ids = kind.get("ids") or range(len(texts))
    assert rows == collections.Counter((i, *w) for i, w in zip(ids, want))
    assert {(r.a, r.b): r.documents for r in pairs.collect()} == dict(held)


def test_equals_an_alignment_token_by_token(spark, tools, scratch):
    rnd = random.Random(1)
    noise = ["".join(rnd.choice("ab \n\té中\U0001f642.,'1") for _ in range(rnd.randrange(1, 60))) for _ in range(150)]
    check(spark, tools, ODD_TEXTS + MORE + noise, scratch, extra=True)


def test_blocks_of_few_rows_and_repeated_and_null_ids(spark, tools, scratch, monkeypatch):
    texts = [words(20, i % 4) for i in range(60)] + [None, ""]
    ids = [i % 7 if i % 9 else None for i in range(len(texts))]
    check(spark, tools, texts, scratch, ids=ids)


def test_empty_table(spark, scratch):
    found, pairs = alignment.aligned(documents(spark, []), scratch)
    assert found.count() == 0 and pairs.count() == 0


def test_bitmaps_keep_every_position_and_plane():
    import numpy as np
    rnd = np.random.default_rng(3)
    for n in (1, 2, 50, 3000, 30000):
        docs = np.sort(rnd.choice(1 << 15, n, replace=False))
        counts = rnd.integers(1, 40, n)
        back = np.zeros(1 << 15, np.int64)
        for k, data in enumerate(alignment.planes(docs, counts)):
            back[alignment.positions(data)] += 1 << k
        assert (back[docs] == counts).all() and back.sum() == counts.sum()


def test_small_blocks(spark, tools):
    """Blocks inside one task: the figures do not depend on where they end."""
    tool = alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [words(30, i) for i in range(5)]
    whole, pairs, rows, counts = alignment.align(tool, texts)
    for i, t in enumerate(texts):
        one, p, _, c = alignment.align(tool, [t])
        assert [one[k][0] for k in one] == [whole[k][i] for k in one]
        assert (p == pairs[rows == i]).all() and (c == counts[rows == i]).all()


def test_query(spark, tools, scratch):
    texts = ODD_TEXTS + MORE
    write(documents(spark, texts), scratch, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in q_alignment.op11_cross_tokenizer(spark, scratch).collect()}
    assert got == dict(enumerate(brute(tools, texts)[0]))
