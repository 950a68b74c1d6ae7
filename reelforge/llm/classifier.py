"""Quality classifier: regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics (logarithms, square roots
and shares, all bounded).  Per class the operator sums 1, x and x x' over all
labelled training rows inside the tasks; these sums (a few hundred numbers)
give means and covariances.  A class covariance is shrunk towards the pooled
one and towards its diagonal and gets a small ridge, then its Cholesky factor
is computed once and sent with the scoring function.  The score is the
logistic of the difference of the classes' log densities: Mahalanobis
distances by triangular solves, log determinants and log priors.

Defined results: a null text scores as an empty one; scores are finite, from
0 to 1; a row without an id counts as training row only if it has a label;
null labels and labels other than 0 and 1 are ignored; with repeated labels
every labelled row counts; without training rows of both classes all scores
equal the share of the class that is there (0.5 for none); an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.textstats import Texts

SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.6, 0.1, 1e-3
THRESHOLD = 0.3


#: Words, characters and lines added to every denominator (20 words of five
#: characters on ten lines), so that one odd word in a short text says little.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 20, 100, 10


def features(t: Texts) -> np.ndarray:
    """Transformed statistics, one row per text.  They are smoothed shares
    and logarithms, so a long clean text looks like a short clean one."""
    words, upper, lower = t.n_words(), t.n_of(bytes(range(65, 91))), t.n_of(bytes(range(97, 123)))
    w, c, n = words + PRIOR_WORDS, t.word_chars() + PRIOR_CHARS, t.n_lines() + PRIOR_LINES
    return np.column_stack([
        np.log1p(words) / 4,
        np.log(c / w),
        np.sqrt(t.n_symbols() / c),
        np.sqrt(t.n_of(b"!?") / c),
        upper / (upper + lower + PRIOR_CHARS),
        np.sqrt(t.n_echo_words() / w),
        t.n_repeat_words() / w,
        t.n_dup_lines() / n,
        np.log((t.n_distinct_words() + PRIOR_WORDS) / w) / np.log(w),
        np.sqrt(t.n_of(b"0123456789") / c),
    ])


N_FEATURES = 10


@dataclass
class Discriminant:
    """A fitted model: per class the mean, the inverse Cholesky factor and
    the log of prior over root determinant; or a constant score."""
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1)
                for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From the sums (n, x, x x') of class 0 and class 1."""
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    if min(n.values()) < 2:
        total = n[0] + n[1]
        return Discriminant(constant=n[1] / total if total else 0.5)
    means = {k: sums[k][1] / n[k] for k in n}
    scatter = {k: sums[k][2] - n[k] * np.outer(means[k], means[k]) for k in n}
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    # Both classes and the spread between them: no feature is without variance.
    middle = (sums[0][1] + sums[1][1]) / (n[0] + n[1])
    whole = (sums[0][2] + sums[1][2]) / (n[0] + n[1]) - np.outer(middle, middle)
    factors, offsets = [], []
    for k in (0, 1):
        c = (1 - SHRINK_POOLED) * scatter[k] / n[k] + SHRINK_POOLED * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c))
        c += RIDGE * np.diag(np.maximum(np.diag(whole), 1e-3))
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.solve(lower, np.eye(len(c))))
        offsets.append(np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array([means[0], means[1]]), np.array(factors), np.array(offsets))


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the feature vector of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in Texts.of(batch.column(1)):
                x = features(texts)
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], names=[id_col, "x"])

    schema = T.StructType([docs.schema[id_col], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def train(examples: DataFrame) -> Discriminant:
    """``examples``: (x, y).  Sums are formed in the tasks and added by Spark;
    2 * (1 + d + d * d) numbers reach the driver."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((1 + N_FEATURES, 1 + N_FEATURES)) for k in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), batch.column(0).flatten().to_numpy().reshape(-1, N_FEATURES)])
            y = batch.column(1).to_numpy()
            for k in total:
                total[k] += x[y == k].T @ x[y == k]
        cells = total[0].size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], cells), pa.int32()), pa.array(np.tile(np.arange(cells), 2), pa.int32()),
             pa.array(np.concatenate([total[0].ravel(), total[1].ravel()]))], names=["y", "cell", "s"])

    rows = (examples.where(F.col("y").isin(0, 1)).select("x", F.col("y").cast("int"))
            .mapInArrow(sums, "y int, cell int, s double").groupBy("y", "cell").agg(F.sum("s").alias("s")).collect())
    out: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    for k in {r.y for r in rows}:
        m = np.zeros((1 + N_FEATURES) ** 2)
        for r in rows:
            if r.y == k:
                m[r.cell] = r.s
        m = m.reshape(1 + N_FEATURES, -1)
        if m[0, 0]:
            out[k] = float(m[0, 0]), m[0, 1:], m[1:, 1:]
    return fit(out)


def scored(vectors: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of feature vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=[id_col, "score"])

    schema = T.StructType([vectors.schema[id_col], T.StructField("score", T.DoubleType())])
    return vectors.select(id_col, "x").mapInArrow(run, schema)


def good_documents(docs: DataFrame, model: Discriminant, text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in Texts.of(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(features(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
