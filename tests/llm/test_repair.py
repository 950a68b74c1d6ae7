"""Conversation repair against a search over whole audits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from helpers import words, write
from reelforge.llm import q_repair, repair

ROWS = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEEP = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def best(rows):
    """(cost, audit, lines) with tuples of (cost, letters) for whole completions."""
    @functools.lru_cache(None)
    def go(i, last, inserts):
        out = []
        if i == len(rows):
            if last in ("", "a"):
                out.append((0, ""))
        else:
            initial, fault = rows[i]
            c, a = go(i + 1, last, 0)
            out.append((c + 4, "D" + a))
            if fault != "gone":
                extra = 3 if fault == "cut" else 0
                if initial and initial in KEEP[last]:
                    c, a = go(i + 1, initial, 0)
                    out.append((c + extra, "K" + a))
                c, a = go(i + 1, NEXT[last], 0)
                out.append((c + 3 + extra, "R" + a))
        if inserts < 4:
            c, a = go(i, NEXT[last], inserts + 1)
            out.append((c + 3, "I" + a))
        return min(out) if out else (10 ** 9, "")

    for i in range(len(rows), -1, -1):  # no deep recursion
        for last in NEXT:
            go(i, last, 0)
    return go(0, "", 0)


def brute(table):
    """The contract row by row: conv_id -> result."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [] if kind == 0 else [(turn, role, text)] * (1 + (kind == 3))
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults, states = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            chars = re.findall("[^\x20\x09-\x0D]", text)
            fault = ("blank" if not chars else "duplicate" if (role, text) in seen
                     else "truncated" if chars[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            states.append((role[:1], {"truncated": "cut", None: "ok"}.get(fault, "gone")))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(states, states[1:]))
        cost, audit = best(tuple(states))
        lines, last, i = [], "", 0
        for letter in audit:
            if letter == "I":
                last = NEXT[last]
                lines.append(f"{ROLE[last]}:")
                continue
            _, role, text = rows[i]
            i += 1
            if letter != "D":
                last = role[:1] if letter == "K" else NEXT[last]
                lines.append(f"{role if letter == 'K' else ROLE[last]}:{text}")
        assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, table, folder, schema=ROWS):
    rows = [tuple(r) + (5, 6, "x", 7) for r in table] if "," in schema[len(ROWS):] else table
    write(spark.createDataFrame(rows, schema), folder, "conversations")
    found = q_repair.op13_conversation_repair(spark, folder).collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    assert got == brute(table)


def invented(seed, n, longest):
    rnd, out = random.Random(seed), []
    texts = ["Yes.", "No", "", " \n\t", None, "a \x0b", "Why? ", "\x85.", "Fine!\n", words(40), words(40) + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "summary", "user", "assistant"]
    for conv in range(n):
        for i in range(rnd.randrange(1, longest)):
            turn = rnd.choice([i, i, i, i + rnd.randrange(3), None])
            role = ("user", "assistant")[i % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            out.append((conv if conv else None, turn, role,
                        f"Text {rnd.randrange(9)}." if rnd.random() < 0.6 else rnd.choice(texts)))
    return out


def test_path_equals_the_search_over_audits():
    rnd = random.Random(2)
    for _ in range(1500):
        rows = [(rnd.choice(["s", "u", "a", "t", ""]), rnd.choice(["ok", "ok", "cut", "gone"]))
                for _ in range(rnd.randrange(9))]
        codes = bytes(max("?sua".find(i or "?"), 0) << 2 | ("ok", "cut", "gone").index(f) for i, f in rows)
        assert repair.path(codes) == best(tuple(rows)), rows


@pytest.mark.parametrize("n", [255, 256, 257, 512, 700])
def test_path_over_many_blocks(n):
    rnd = random.Random(n)
    rows = [(rnd.choice("uuaast"), rnd.choice(["ok", "ok", "cut", "gone"])) for _ in range(n)]
    codes = bytes("?sua".find(i if i in "sua" else "?") << 2 | ("ok", "cut", "gone").index(f) for i, f in rows)
    assert repair.path(codes) == best(tuple(rows))


def test_path_of_a_very_long_conversation():
    cost, audit = repair.path(bytes([2 << 2, 3 << 2]) * 50_000)
    assert (cost, audit) == (0, "K" * 100_000)


def test_invented_conversations(spark, scratch):
    check(spark, invented(1, 150, 14), scratch)


def test_one_hot_conversation_and_extra_columns(spark, scratch):
    table = invented(2, 20, 10) + [(3, t, ("user", "assistant")[t % 2], f"Text {t % 50}.") for t in range(2000)]
    check(spark, table, scratch, ROWS + ", n long, kind long, digest string, first long")


def test_rows_that_are_all_dropped_and_repeated_rows(spark, scratch):
    dropped = [t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0]
    table = [(1, t, "user", "x.") for t in dropped] + [(2, 1, "user", "x.")] * 5 + [(2, 2, "user", "y")] * 2
    check(spark, table, scratch)


def test_long_text_and_empty_table(spark, scratch, tmp_path):
    check(spark, [(1, 0, "user", "x" * 300_000), (1, 1, "assistant", " " * 300_000)], scratch)
    empty = tmp_path / "empty"
    write(spark.createDataFrame([], ROWS), str(empty), "conversations")
    assert q_repair.op13_conversation_repair(spark, str(empty)).count() == 0
