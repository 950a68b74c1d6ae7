"""Structure repair of conversations by a shortest path over big integers.

A conversation should have the role initials ``(s?(ua)+)?``: an optional
system turn, then user and assistant turns in pairs.  Every row is kept (K,
free), given the role that may stand there (R, 3), or deleted (D, 4; forced
for blank rows and repeats); a user or assistant turn without text may be
inserted anywhere (I, 3).  A truncated row that stays adds 3.  The cheapest
edits win, of equally cheap ones the ASCII-least audit (their letters in order).

The path runs over a DAG of (row, what the last turn was).  A node's weight is
one integer: the high digits are the cost of its best completion, the low
digits, of fixed width, are the letters of its audit from the left with zeros
behind the end.  Going one edge back adds the edge's cost, moves the letters
one place and puts the edge's own in front; the ordinary minimum of integers
decides cost and ties at once.  The nodes of a gap have at most two inserted
turns: three come back to the state of one.  From the end back, every BLOCK
rows the weights are kept and their letters cleared, so integers stay short:
two edges out of a node never have the same letter, hence two completions
differ within a block before any cleared place can matter.

1. Rows are counted by (conversation, turn, role, digest of the text); a
   repeat is what is not the first of its role and digest.  No text travels.
2. Sorted rows stream through a task, a conversation leaves one byte per row;
   the DP gives ``decisions``.
3. The sorted rows with their texts stream once more behind their audit and
   leave as repaired turns.  A task never holds a conversation's texts.

Defined results: a null role or text counts as one space; a null turn comes
first; rows of one turn go by role, then by digest of the text; a null
conversation id is a conversation; an empty role has no initial and fits
nowhere; a gap count beyond 2**63-1 is given as that; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.common import stored

BLANKS = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
LETTERS = " DIKR"  # in the order of their code points; digit 0 is the end
D, I, K, R = 1, 2, 3, 4
#: What the last turn was: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The user or assistant turn that may come next, and that state's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = (None, None, "user", "assistant")
ACCEPTED = (START, ASSISTANT)
FITS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
INITIALS = "?sua"  # ? stands for every other initial and for none
#: Rows between two clearings of the letters; bits of a letter.
BLOCK, BITS = 256, 3
WIDTH = BITS * (3 * BLOCK + 2)
FRONT = WIDTH - BITS
LOW = (1 << WIDTH) - 1
NEVER = 1 << (WIDTH + 62)
GOOD, CUT, GONE = range(3)  # a row's fault as the path sees it
BLANK_ROW, REPEAT = 3, 4  # how a GONE row is counted


# --- the path -------------------------------------------------------------------

def _edge(letter: int, cost: int, after: int) -> int:
    """The weight of an edge and the completion behind it."""
    return ((after >> WIDTH) + cost << WIDTH) | (letter << FRONT) | ((after & LOW) >> BITS)


def _with_inserts(weights: list[int]) -> list[int]:
    """Best completions when up to two turns may be inserted first."""
    once = [min(weights[s], _edge(I, INSERT, weights[NEXT[s]])) for s in range(4)]
    return [min(weights[s], _edge(I, INSERT, once[NEXT[s]])) for s in range(4)]


def _letters(weight: int) -> str:
    out, place = [], FRONT
    while place >= 0 and (digit := (weight >> place) & 7):
        out.append(LETTERS[digit])
        place -= BITS
    return "".join(out)


def path(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation; a row is its initial's number in
    INITIALS times 4 plus its fault (GOOD, CUT, GONE)."""
    weights = _with_inserts([0 if s in ACCEPTED else NEVER for s in range(4)])
    kept = []
    for end in range(len(rows), 0, -BLOCK):
        for i in range(end - 1, max(end - BLOCK, 0) - 1, -1):
            initial, fault = INITIALS[rows[i] >> 2], rows[i] & 3
            after, own = weights, []
            for s in range(4):
                best = _edge(D, DELETE, after[s])
                if fault != GONE:
                    extra = TRUNCATED if fault == CUT else 0
                    if (s, initial) in FITS:
                        best = min(best, _edge(K, extra, after[FITS[s, initial]]))
                    best = min(best, _edge(R, REROLE + extra, after[NEXT[s]]))
                own.append(best)
            weights = _with_inserts(own)
        kept.append(weights)
        if end > BLOCK:
            weights = [w >> WIDTH << WIDTH for w in weights]
    if not kept:
        return weights[START] >> WIDTH, _letters(weights[START])
    state, at, audit = START, 0, []
    for block in reversed(kept):
        audit.append(_letters(block[state]))
        for letter in audit[-1]:
            if letter == "K":
                state = FITS[state, INITIALS[rows[at] >> 2]]
            elif letter != "D":
                state = NEXT[state]
            at += letter != "I"
    return kept[-1][START] >> WIDTH, "".join(audit)


# --- rows without texts -----------------------------------------------------------

def _filled(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
                      F.coalesce(present, F.lit(False)).alias("present"))
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


def counted_rows(filled: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, present, ends, n): equal rows of a turn are
    one; ``ends`` is the last character that is no blank ('' if there is none)."""
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    here = F.col("present")
    return (filled.select("conv", "present", F.when(here, F.col("turn")).alias("turn"),
                          F.when(here, F.col("role")).alias("role"), F.when(here, F.col("digest")).alias("digest"),
                          F.when(here, F.right(text, F.lit(1))).alias("ends"))
            .groupBy("conv", "present", "turn", "role", "digest", "ends").agg(F.count(F.lit(1)).alias("n")))


def decisions(filled: DataFrame, folder: str) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    rows = stored(counted_rows(filled), folder, "rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = (rows.where("present").groupBy("conv", "role", "digest").agg(F.min(order).alias("first"))
             .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    marked = (rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & F.col("role").eqNullSafe(F.col("r"))
                        & F.col("digest").eqNullSafe(F.col("d")), "left")
              .select("conv", "present", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "ends",
                      "n", order.eqNullSafe(F.col("first")).alias("is_first")))
    schema = T.StructType([T.StructField("conv", filled.schema["conv"].dataType),
                           *[T.StructField(c, T.LongType()) for c in
                             ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, done = to_arrow_schema(schema), []
        conv, open_ = None, False

        def fresh():
            return bytearray(), [0, 0, 0], 0, {"low": None, "high": None, "turns": 0, "last": None}

        codes, faults, illegal, seen = fresh()

        def finish():
            cost, audit = path(bytes(codes))
            gaps = 0 if seen["low"] is None else seen["high"] - seen["low"] + 1 - seen["turns"]
            done.append((conv, min(gaps, (1 << 63) - 1), *faults, illegal, cost, audit))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), arrow)],
                                              schema=arrow)

        for batch in batches:
            for c, present, turn, initial, ends, n, is_first in zip(*(batch.column(k).to_pylist() for k in (
                    "conv", "present", "turn", "initial", "ends", "n", "is_first"))):
                if not open_ or c != conv:
                    if open_:
                        finish()
                    conv, open_ = c, True
                    codes, faults, illegal, seen = fresh()
                if not present:
                    continue
                if turn is not None and turn != seen["high"]:
                    seen["low"] = turn if seen["low"] is None else seen["low"]
                    seen["high"], seen["turns"] = turn, seen["turns"] + 1
                number = max(INITIALS.find(initial), 0) if initial else 0
                first_fault = BLANK_ROW if ends == "" else REPEAT if not is_first else GOOD if ends in ".!?" else CUT
                other_fault = BLANK_ROW if ends == "" else REPEAT
                for fault, times in ((first_fault, 1), (other_fault, n - 1)):
                    codes += bytes([number << 2 | min(fault, GONE)]) * times
                    faults[0] += times * (fault == BLANK_ROW)
                    faults[1] += times * (fault == REPEAT)
                    faults[2] += times * (fault == CUT)
                own = initial or ""
                illegal += (seen["last"] is not None and seen["last"] + own not in LEGAL) + n - 1
                seen["last"] = own
            if done:
                yield table()
                done.clear()
        if open_:
            finish()
            yield table()

    return (marked.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest")
            .mapInArrow(run, schema))


# --- repaired turns -----------------------------------------------------------------

def repaired_turns(filled: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv, position, edit, role, text) of the turns that stay or are put in.
    The rows of a conversation lie in one partition, in order."""
    kind = filled.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("position", T.LongType()),
                           T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType())])
    turns = filled.where("present").select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text",
                                           F.lit(None).cast("string").alias("audit"))
    heads = decided.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(turns.schema[c].dataType).alias(c)
                                                            for c in ("turn", "role", "digest", "text")], "audit")
    together = (turns.unionByName(heads).repartition("conv")
                .sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        conv, audit, at, state, position = None, "", 0, START, 0
        out: list[tuple] = []

        def inserted():
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                state, at = NEXT[state], at + 1
                out.append((conv, position, "I", ROLE[state], ""))
                position += 1

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)],
                                              schema=arrow)

        for batch in batches:
            for c, head, role, text, letters in zip(*(batch.column(k).to_pylist() for k in (
                    "conv", "kind", "role", "text", "audit"))):
                if head == 0:
                    inserted()  # the end of the conversation before
                    conv, audit, at, state, position = c, letters, 0, START, 0
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = NEXT[state] if edit == "R" else FITS[state, role[:1]]
                    out.append((conv, position, edit, ROLE[state] if edit == "R" else role, text))
                    position += 1
            if out:
                yield table()
                out.clear()
        inserted()
        if out:
            yield table()

    return together.drop("turn", "digest").mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of ``role:text`` lines joined by a line feed; the turns
    come as ``repaired_turns`` leaves them."""
    schema = T.StructType([turns.schema["conv"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        conv, digest, done = None, None, []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), arrow)],
                                              schema=arrow)

        for batch in batches:
            for c, position, role, text in zip(*(batch.column(k).to_pylist() for k in (
                    "conv", "position", "role", "text"))):
                if position == 0:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield table()
                done.clear()
        if digest:
            done.append((conv, digest.hexdigest()))
            yield table()

    return turns.mapInArrow(run, schema)


def repaired(rows: DataFrame, folder: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, repaired turns).  Rows for which ``present`` does not hold
    only name their conversation."""
    filled = _filled(rows, conv_col, turn_col, role_col, text_col, F.lit(True) if present is None else present)
    decided = stored(decisions(filled, folder), folder, "decisions")
    return decided, repaired_turns(filled, decided)
