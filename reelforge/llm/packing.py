"""Packing examples into training sequences by vector bin packing.

A sequence has limits on three sums at once: tokens, segments (pieces) and
loss-bearing tokens.  An open sequence takes, of the pending pieces that fit
all limits, the one whose demand vector has the largest dot product with the
room that is left (both as shares of the limits).  When none fits, the piece
with the largest dot product is cut so that a limit is met exactly.  Examples
beyond a limit are first cut into full sequences.

Each task packs the examples of its own input split, holding a bounded pool
of pending pieces; no shuffle is needed and a lost task packs again the same
way.  A sequence that cannot be filled (the last of a task, or one at its
segment limit) is split at powers of two, which need no padding.

An example is a list of parts (text, bears loss); its ids are those of the
parts in a row and one end id.  Defined results: a null list or text is
empty, so an empty example is its end id alone; a null loss flag is false;
equal rows are packed separately; an empty table gives no pieces; a null id
is carried; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.tokens import encoder, vocabulary_path

END_ID = 1
POOL = 512
BATCH_CHARS, OUT_IDS = 1 << 21, 1 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Piece:
    example: object
    total: int
    start: int
    ids: np.ndarray
    loss: np.ndarray  # loss-bearing tokens up to each position, one longer than ids

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, int(self.loss[-1] - self.loss[0])

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.example, self.total, self.start, self.ids[:n], self.loss[:n + 1]),
                Piece(self.example, self.total, self.start + n, self.ids[n:], self.loss[n:]))

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest prefix within both limits."""
        most = int(np.searchsorted(self.loss, self.loss[0] + loss, "right")) - 1
        return min(tokens, most, len(self.ids))


class Packer:
    """Packs a stream of examples; ``closed`` gives finished sequences."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Piece] = []
        self.demands = np.empty((2 * POOL, 3))  # of the pool's pieces, as shares of the limits

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while True:
            n = piece.fitting(self.limits.tokens, self.limits.loss)
            if n == len(piece.ids) and n < self.limits.tokens:
                break
            head, piece = piece.cut(n)
            yield [head]
            if not len(piece.ids):
                return
        self._pend(piece)
        if len(self.pool) >= POOL:
            yield self._fill()

    def flush(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield self._fill()

    def _pend(self, piece: Piece) -> None:
        self.demands[len(self.pool)] = piece.demand()
        self.demands[len(self.pool)] /= self.full
        self.pool.append(piece)

    def _take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i], self.demands[i] = last, self.demands[len(self.pool)]
        return piece

    def _fill(self) -> list[Piece]:
        room, out = self.full.copy(), []
        while self.pool and room[0] > 0 and room[1] > 0:
            share = room / self.full
            demands = self.demands[:len(self.pool)]
            score = demands @ share
            over = demands > share + 1e-12
            best = int(np.argmax(np.where(over[:, 0] | over[:, 1] | over[:, 2], -1.0, score)))
            if not over[best].any():
                piece = self._take(best)
            else:
                i = int(np.argmax(score))
                n = self.pool[i].fitting(int(room[0]), int(room[2]))
                if n <= 0:
                    break
                piece, rest = self._take(i).cut(n)
                self._pend(rest)
            out.append(piece)
            room -= piece.demand()
        return out


def at_powers_of_two(sequence: list[Piece], tokens: int) -> Iterator[list[Piece]]:
    """The sequence itself if it is full, else its parts at powers of two."""
    left, rest = sum(len(p.ids) for p in sequence), list(sequence)
    if left == tokens:
        yield rest
        return
    while left:
        size = want = 1 << (left.bit_length() - 1)
        part: list[Piece] = []
        while want:
            piece = rest.pop(0)
            if len(piece.ids) > want:
                piece, more = piece.cut(want)
                rest.insert(0, more)
            part.append(piece)
            want -= len(piece.ids)
        left -= size
        yield part


def packed(examples: DataFrame, id_col: str, parts_col: str, limits: Limits = Limits(),
           vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the example's id, ``start`` (its ids before the
    piece), ``length``, ``ids`` (little-endian unsigned 32-bit), ``loss_tokens``,
    ``doc_tokens`` (of the whole example), ``sequence_id`` and ``offset``."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(limits)
        base, number, rows, held = TaskContext.get().partitionId() << 40, 0, [], 0

        def put(sequence: list[Piece]) -> None:
            nonlocal number, held
            for part in at_powers_of_two(sequence, limits.tokens):
                offset = 0
                for p in part:
                    rows.append((p.example, p.start, len(p.ids), p.ids.astype("<u4").tobytes(),
                                 int(p.loss[-1] - p.loss[0]), p.total, base + number, offset))
                    offset += len(p.ids)
                held += offset
                number += 1

        def out() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = types or [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                              pa.int64(), pa.int64()]
            for lo in range(0, batch.num_rows, 256):
                block = batch.slice(lo, 256)
                for example, ids, loss in encoded(enc, block, end_id):
                    for sequence in packer.add(Piece(example, len(ids), 0, ids, loss)):
                        put(sequence)
                    if held >= OUT_IDS:
                        yield out()
        for sequence in packer.flush():
            put(sequence)
        if rows:
            yield out()

    names = [id_col, "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([examples.schema[id_col]] + [
        T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in names[1:]])
    return examples.select(id_col, parts_col).mapInArrow(run, schema)


def encoded(enc, block: pa.RecordBatch, end_id: int) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(id, ids with the end id, loss-bearing ids up to each place) of every example of a block."""
    parts = block.column(1)
    flat_parts = parts.flatten()
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_pylist()
    flat = pc.fill_null(pc.struct_field(flat_parts, "text"), "").to_pylist()
    losses = pc.fill_null(pc.struct_field(flat_parts, "loss"), False).to_pylist()
    ids: list[np.ndarray] = []
    begin = size = 0
    for i, text in enumerate(flat):  # groups of bounded size
        size += len(text)
        if size >= BATCH_CHARS:
            ids += enc.encode(flat[begin:i + 1])
            begin, size = i + 1, 0
    ids += enc.encode(flat[begin:])
    end, at = np.array([end_id], np.uint32), 0
    for example, n in zip(block.column(0).to_pylist(), counts):
        own, flags = ids[at:at + n], losses[at:at + n]
        at += n
        sizes = [len(x) for x in own]
        if all(flags):
            loss = np.arange(sum(sizes) + 2, dtype=np.int64)
        else:
            loss = np.zeros(sum(sizes) + 2, np.int64)
            np.cumsum(np.repeat([*flags, flags[-1]], [*sizes, 1]), out=loss[1:])
        yield example, np.concatenate([*own, end]), loss


def document_parts(text: Column) -> Column:
    """A document as an example: one part, all of it bearing loss."""
    return F.array(F.struct(text.cast("string").alias("text"), F.lit(True).alias("loss")))


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    return packed(docs.select(F.col(id_col), document_parts(F.col(text_col)).alias("_pk_parts")),
                  id_col, "_pk_parts", **options)
