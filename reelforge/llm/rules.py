"""Quality rules as a short-circuit cascade.

A rule rejects a text from a few of its measures (``textstats``).  On a
bounded sample (``SAMPLE_ROWS`` rows) the cost of every rule and its verdicts
are measured; the cascade then runs the rules in the order of rejected
documents per second, each next rule weighed on what the ones before it left.
A rule is computed only for the texts that no earlier rule has rejected.  The
verdict (no rule rejects) is the same in any order, so the sample decides the
speed and never the result.

Defined results: a null text is an empty text; measures of an empty text are
0 (the production rules reject it as too short); equal rows get equal
verdicts; an empty table keeps its schema; other columns are not read by
``judged`` and are kept as they are by ``kept_documents``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.textstats import Texts

SAMPLE_ROWS, SAMPLE_CHARS = 512, 100_000
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": Texts.n_words,
    "word_chars": Texts.word_chars,
    "n_symbols": Texts.n_symbols,
    "n_lines": Texts.n_lines,
    "n_dup_lines": Texts.n_dup_lines,
    "n_repeat_words": Texts.n_repeat_words,
    "n_echo_words": Texts.n_echo_words,
    "n_upper": lambda t: t.n_of(UPPER),
    "n_lower": lambda t: t.n_of(LOWER),
    "n_exclaims": lambda t: t.n_of(b"!"),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: Base rules: too few words, too much of the text inside repeated windows.
BASE = (
    Rule("too_short", ("n_words",), lambda w: w < 20),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda w, r: 100 * r > 30 * w),
)
RULES = BASE + (
    Rule("symbols", ("word_chars", "n_symbols"), lambda c, s: 20 * s > c),
    Rule("shouting", ("n_upper", "n_lower"), lambda u, l: 10 * u > 6 * (u + l)),
    Rule("exclaims", ("n_words", "n_exclaims"), lambda w, e: 10 * e > 3 * w),
    Rule("echoes", ("n_words", "n_echo_words"), lambda w, e: 5 * e > w),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n),
)


class Measured:
    """Measures of the rows of a slice, computed for the rows still asked for."""

    def __init__(self, texts: Texts):
        self.texts, self.rows, self.known = texts, np.arange(texts.n), {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = MEASURES[name](self.texts)
        return self.known[name]

    def keep(self, mask: np.ndarray) -> None:
        """Go on with the marked rows; the word tables shrink with them."""
        if mask.all():
            return
        at = np.flatnonzero(mask)
        self.rows, self.texts = self.rows[at], self.texts.take(at)
        self.known = {k: v[at] for k, v in self.known.items()}


def passed(texts: Texts, rules, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Which texts no rule rejects; every rule sees only the survivors."""
    m = Measured(texts)
    m.known |= known or {}
    for rule in rules:
        if not len(m.rows):
            break
        m.keep(~rule.rejects(*[m.get(n) for n in rule.needs]))
    out = np.zeros(texts.n, bool)
    out[m.rows] = True
    return out


def order_rules(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, estimated on at most ``sample_rows``
    texts of at most ``SAMPLE_CHARS`` characters, which come to the driver
    (the read stops as soon as it has them).  A rule's cost counts what it
    needs on a fresh slice."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sample = docs.select(text.alias("t")).where(F.length("t") <= SAMPLE_CHARS).limit(sample_rows).collect()
    texts = [x for _, _, x in Texts.of(pa.array([r.t for r in sample], pa.string()))]
    cost: dict[str, float] = {}
    verdict: dict[str, np.ndarray] = {}
    for rule in rules:
        began, parts = time.process_time(), []
        for t in texts:
            fresh = Texts(t.data, t.offsets)
            parts.append(rule.rejects(*[MEASURES[n](fresh) for n in rule.needs]))
        cost[rule.name] = time.process_time() - began + 1e-9
        verdict[rule.name] = np.concatenate([np.empty(0, bool), *parts])
    left = np.ones(len(sample), bool)
    todo, order = list(rules), []
    while todo:
        best = max(todo, key=lambda r: ((verdict[r.name] & left).sum() / cost[r.name], -cost[r.name]))
        left &= ~verdict[best.name]
        order.append(best)
        todo.remove(best)
    return order


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
           measures: tuple[str, ...] = (), order: list[Rule] | None = None) -> DataFrame:
    """(id, the named measures of every whole text, kept)."""
    order = order_rules(docs, text_col, rules) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in Texts.of(batch.column(1)):
                known = {n: MEASURES[n](texts) for n in measures}
                kept = passed(texts, order, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(known[n], pa.int64()) for n in measures],
                     pa.array(kept)], names=[id_col, *measures, "kept"])

    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, T.LongType()) for n in measures],
                           T.StructField("kept", T.BooleanType())])
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = order_rules(docs, text_col, rules)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in Texts.of(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(passed(texts, order)))

    return docs.mapInArrow(run, docs.schema)
