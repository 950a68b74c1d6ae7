import re

from helpers import ODD_TEXTS, documents, words

from reelforge.llm import rules
from reelforge.llm.q_rules import BASE_MEASURES

LINE_WORD = re.compile("[^\x20\x09-\x0D]")


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if LINE_WORD.search(x)]
    m = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    echo = sum(a == b for a, b in zip(w, w[1:]))
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    bad = (m[0] < 20 or 100 * m[4] > 30 * m[0] or 20 * m[2] > m[1] or 10 * upper > 6 * (upper + lower)
           or 10 * text.count("!") > 3 * m[0] or 5 * echo > m[0] or 2 * m[3] > len(lines))
    return (*m, not bad)


TEXTS = ODD_TEXTS + [
    words(100), words(100) + "\n" + words(100), (words(12) + "\n") * 4, words(60).upper(), "a! " * 30 + words(40),
    " ".join(w + " " + w for w in words(40).split()), "\n".join([words(6, 1), words(6, 2)] * 9 + [words(60, 5)]),
    words(40) + " | " * 30, "a\r\nb\r\na\r\n" + words(25)]


def test_measures_and_verdicts_match_brute_force(spark):
    df = documents(spark, TEXTS, extra=True)
    got = rules.judged(df, measures=BASE_MEASURES).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_any_order_gives_the_same_verdict(spark):
    df = documents(spark, TEXTS)
    want = {r.doc_id: r.kept for r in rules.judged(df).collect()}
    for order in (list(rules.RULES), list(rules.RULES)[::-1]):
        assert {r.doc_id: r.kept for r in rules.judged(df, order=order).collect()} == want
    kept = rules.kept_documents(documents(spark, TEXTS, extra=True))
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if v}
    assert kept.columns == documents(spark, TEXTS, extra=True).columns


def test_order_prefers_rejections_per_cost(spark):
    df = documents(spark, ["! " * 30] * 50 + [words(50, i) for i in range(50)])
    order = rules.order_rules(df)
    assert sorted(r.name for r in order) == sorted(r.name for r in rules.RULES)
    names = [r.name for r in order]
    assert min(names.index("exclaims"), names.index("echoes"), names.index("repeated_windows"),
               names.index("shouting")) < names.index("symbols")


def test_later_rules_see_survivors_only(spark):
    from reelforge.llm.textstats import Texts
    import pyarrow as pa

    seen = []
    first = rules.Rule("short", ("n_words",), lambda w: w < 3)
    second = rules.Rule("spy", ("word_chars",), lambda c: (seen.append(len(c)), c > 10**9)[1])
    for _, _, t in Texts.of(pa.array(["a", "a b c", None, "d e f g"])):
        assert rules.passed(t, [first, second]).tolist() == [False, True, False, True]
    assert seen == [2]


def test_empty_table_and_null_ids(spark):
    df = documents(spark, TEXTS)
    assert rules.judged(df.limit(0), measures=BASE_MEASURES).collect() == []
    assert rules.kept_documents(df.limit(0)).collect() == []
    got = rules.judged(documents(spark, [words(50), None], ids=[None, None])).collect()
    assert [tuple(r) for r in got] == [(None, True), (None, False)]
