import random
import re

import pytest
from helpers import ODD_TEXTS, documents, words, write
from hypothesis import given, settings
from hypothesis import strategies as st

from reelforge.llm import edits as E
from reelforge.llm import tokens
from reelforge.llm.q_edits import EMAIL, op4_token_counts

ENC = tokens.encoder(tokens.vocabulary_path())


def count(text):
    return len(ENC.tokenizer.encode(text, add_special_tokens=False).ids)


def apply(text, tree, chars, edits):
    for a, b, own in E.touched(text, chars, edits):
        ps = E.pieces(own, b - a)
        for j in range(a, b):
            full = j - a < len(ps)
            chars[j] = len(ps[j - a]) if full else 0
            E.update(tree, j, count(ps[j - a]) if full else 0)
    return E.edited(text, edits)


ALPHABET = st.text(alphabet="ab  \n'é1.s🙂-\x1c\xa0", max_size=80)
EDITS = st.lists(st.tuples(st.integers(-2, 90), st.integers(-2, 90), st.text(alphabet="ab  \n'é1", max_size=6)), max_size=4)


@settings(max_examples=300, deadline=None)
@given(ALPHABET, st.lists(EDITS, min_size=1, max_size=3), st.sampled_from([1, 4, 16]))
def test_counts_after_edits_equal_a_full_count(text, rounds, size):
    old, E.PIECE_CHARS = E.PIECE_CHARS, size
    try:
        parts = E.pieces(text)
        assert "".join(parts) == text
        tree, chars = E.heap([count(p) for p in parts]), [len(p) for p in parts]
        assert E.tokens(tree) == count(text)
        for edits in rounds:
            edits = E.clean_edits([dict(start=a, end=b, replacement=r) for a, b, r in edits], len(text))
            text = apply(text, tree, chars, edits)
            assert sum(chars) == len(text) and E.tokens(tree) == count(text)
            n = len(chars)
            assert all(tree[i] == tree[2 * i] + tree[2 * i + 1] for i in range(1, n))
    finally:
        E.PIECE_CHARS = old


def test_only_touched_pieces_are_encoded_again(spark):
    text = words(20_000, 1)
    trees = E.build_trees(documents(spark, [text, text, None]))
    log = spark.createDataFrame([(0, 50_000, 50_004, "new words here"), (0, 10, 12, None), (2, 0, 0, "late")],
                                "id long, start int, end int, replacement string")
    rows = {r.id: r for r in E.apply_edits(E.with_edits(trees, log)).collect()}
    after = text[:10] + text[12:50_000] + "new words here" + text[50_004:]
    assert rows[0].text == after and rows[0].tokens_after == count(after) and rows[0].tokens_before == count(text)
    assert 2 <= rows[0].leaves_encoded <= 4 < len(rows[0].leaf_chars) and rows[0].n_edits == 2
    assert (rows[1].tokens_after, rows[1].leaves_encoded, rows[1].n_edits) == (count(text), 0, 0)
    assert rows[2].text == "late" and rows[2].tokens_after == count("late")


def test_the_query_equals_counting_twice(spark, scratch):
    texts = ODD_TEXTS + [words(40, i) + f" mail a.b{i}@mail{i}.example.com, and x@y.z " + words(300, i) for i in range(20)]
    write(documents(spark, texts, extra=True), scratch, "documents")
    for r in op4_token_counts(spark, scratch).collect():
        text = texts[r.doc_id] or ""
        new, n = re.subn(EMAIL, "<email>", text)
        assert (r.n_tokens, r.n_edits, r.n_tokens_edited) == (count(text), n, count(new))


def test_empty_table_null_ids_and_null_edits(spark):
    df = documents(spark, ["a b", "a b"], ids=[None, None])
    trees = E.build_trees(df)
    log = spark.createDataFrame([(None, 0, 1, "x"), (7, None, None, None)], "id long, start int, end int, replacement string")
    rows = E.apply_edits(E.with_edits(trees, log)).collect()
    assert [(r.id, r.text, r.n_edits) for r in rows] == [(None, "a b", 0)] * 2
    empty = E.build_trees(df.limit(0))
    assert E.apply_edits(empty, mask=(EMAIL, "")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_heap_sums(n):
    rng = random.Random(n)
    counts = [rng.randrange(9) for _ in range(n)]
    tree = E.heap(counts)
    for _ in range(20):
        i = rng.randrange(n)
        counts[i] = rng.randrange(9)
        E.update(tree, i, counts[i])
        assert tree == E.heap(counts) and E.tokens(tree) == sum(counts)


def test_fifty_thousand_matches_in_one_text_take_seconds(spark):
    import time
    text = "\n".join(f"From: name{i}@example{i % 97}.org wrote {words(3, i)}" for i in range(50_000))
    trees = E.build_trees(documents(spark, [text])).persist()
    trees.count()
    begun = time.time()
    row = E.apply_edits(trees, mask=(EMAIL, "<email>")).collect()[0]
    assert time.time() - begun < 15
    trees.unpersist()
    after = re.sub(EMAIL, "<email>", text)
    assert row.n_edits == 50_000 and row.text == after and row.tokens_after == count(after)
