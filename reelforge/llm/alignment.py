"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

One pass encodes every whole text with a byte-level vocabulary A (of
space + text) and a piece vocabulary B (of the text; it adds the space), cuts
the bytes where tokens of either end and so finds all links: the occurrence
pairs whose byte ranges overlap share exactly one piece between two
neighbouring cuts.  Where both end, a group ends.

Documents are numbered inside blocks (rows of one scan task, bounded in bytes
and rows).  A block's inverted list has, for each linked id pair, multiplicity
planes: plane k is a compressed bitmap of the documents whose number of links
of that pair has bit k set.  The OR of the planes is the pair's document
bitmap.  Blocks hold different documents, so a pair's merged bitmap is the
union of its blocks' containers and its document count the sum of their
popcounts; link counts are the planes' popcounts weighted by 2**k.

The score of a pair (its document count, and whether that is the highest of
its A id) then travels back along the postings: each block adds
score * 2**k at the documents of plane k.  Nothing per document and pair is
ever a row, a pair that all documents share is one row per block.

Defined results: a null or empty text, or one whose joined token bytes differ
from space + text in either vocabulary (U+2581 in the text), has no tokens:
all figures 0 and an empty digest; special tokens' strings are plain text; a
text of any length is aligned whole, as a block of its own if it is long;
repeated rows are documents of their own and a null id is carried; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.common import stored, text_slices
from reelforge.llm.tokens import Encoder

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A block of documents ends at this many bytes of text or rows (16-bit positions).
BLOCK_BYTES, BLOCK_ROWS = 24 << 20, 1 << 15
#: A pair is one number: A id, then B id in the low bits.
B_BITS = 24

DOC_COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


# --- the two vocabularies ----------------------------------------------------

class Aligner:
    """Both vocabularies of one worker."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = Encoder(byte_path)
        self.a.special = lambda _: None  # special tokens' strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                  else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.b_bytes = np.array(pieces, object)
        self.b_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.a_bytes = self._byte_level(self.a.tokenizer.get_vocab())
        most = max(len(self.a_bytes), len(pieces))
        # Decimal ids and a separator as rows of bytes; unused places are 0.
        digits = np.char.mod("%d", np.arange(most)).astype("S")
        self.decimal = np.frombuffer(digits.tobytes(), np.uint8).reshape(most, -1)

    @staticmethod
    def _byte_level(vocabulary: dict[str, int]) -> np.ndarray:
        """Bytes of each token: printable Latin-1 characters stand for
        themselves, the other bytes for the code points from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        value = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        out = np.full(max(vocabulary.values()) + 1, b"", object)
        for token, i in vocabulary.items():
            out[i] = bytes(value[c] for c in token if c in value)
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both vocabularies; a text that either changes has none."""
        none = np.empty(0, np.int64)
        wanted = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in wanted]
        out_a, out_b = [none] * len(texts), [none] * len(texts)
        for i, raw, x, y in zip(wanted, spaced, self.a.encode(spaced),
                                self.b.encode([texts[i] for i in wanted], num_threads=1)):
            x, y, plain = x.astype(np.int64), np.array(y, np.int64), raw.encode()
            if b"".join(self.a_bytes[x]) == plain and b"".join(self.b_bytes[y]) == plain:
                out_a[i], out_b[i] = x, y
        return out_a, out_b


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


# --- groups and links of one slice of texts ----------------------------------

def _ends(ids: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, byte ends, texts) of the tokens of all texts, laid end to end."""
    flat = np.concatenate([*ids, np.empty(0, np.int64)])
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return flat, np.cumsum(size[flat]), rows


def _digests(decimal: np.ndarray, n: int, a: np.ndarray, a_group: np.ndarray, a_rows: np.ndarray,
             b: np.ndarray, b_group: np.ndarray, b_rows: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    group = np.concatenate([a_group, b_group])
    order = np.argsort(group * 2 + side, kind="stable")
    side, group = side[order], group[order]
    ids, rows = np.concatenate([a, b])[order], np.concatenate([a_rows, b_rows])[order]
    width = decimal.shape[1]
    line = np.empty((len(ids), width + 1), np.uint8)
    line[:, :width] = decimal[ids]
    line[:, width] = ord(",")
    change = (np.diff(group) != 0) | (np.diff(side) != 0)
    last = np.append(change, True) if len(ids) else change[:0]
    line[last, width] = np.where(side[last] == 0, ord("|"), ord(";"))
    if len(ids):
        line[np.append(np.diff(rows) != 0, True), width] = 0  # nothing after a text's last group
    written = np.concatenate([[0], np.cumsum((line != 0).sum(1))])
    data = line[line != 0].tobytes()
    at = written[np.searchsorted(rows, np.arange(n + 1))]
    return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:])]


def align(tool: Aligner, texts: list[str]) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each text, then (pair, text, links) of every linked pair."""
    n = len(texts)
    ids_a, ids_b = tool.encode(texts)
    a, end_a, rows_a = _ends(ids_a, tool.a.id_bytes)
    b, end_b, rows_b = _ends(ids_b, tool.b_size)
    cuts = np.union1d(end_a, end_b)
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    rows = rows_a[at_a]
    pairs, counts = np.unique(rows * (1 << 48) + ((a[at_a] << B_BITS) | b[at_b]), return_counts=True)
    figures = {"n_a": [len(x) for x in ids_a], "n_b": [len(x) for x in ids_b],
               "n_groups": np.bincount(rows_a[np.searchsorted(end_a, both)], minlength=n).tolist(),
               "n_links": np.bincount(rows, minlength=n).tolist(),
               "groups_sha256": _digests(tool.decimal, n, a, np.searchsorted(both, end_a), rows_a,
                                         b, np.searchsorted(both, end_b), rows_b)}
    return figures, pairs & ((1 << 48) - 1), pairs >> 48, counts


# --- compressed bitmaps -------------------------------------------------------

def bitmap(positions: np.ndarray) -> bytes:
    """Sorted positions below 2**16: a list of 16-bit numbers, or bits where that is shorter."""
    if len(positions) == 0:
        return b""
    dense = (int(positions[-1]) >> 3) + 1
    if 2 * len(positions) <= dense:
        return b"L" + positions.astype("<u2").tobytes()
    bits = np.zeros(dense * 8, np.uint8)
    bits[positions] = 1
    return b"B" + np.packbits(bits).tobytes()


def positions(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    if data[:1] == b"L":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def planes(documents: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Plane k has the documents whose count has bit k set."""
    if len(counts) == 1 and counts[0] == 1:
        return [b"L" + int(documents[0]).to_bytes(2, "little")]
    return [bitmap(documents[(counts >> k) & 1 == 1]) for k in range(int(counts.max()).bit_length())]


def _inverted(pairs: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(pair, documents, links, planes) of every pair of a block."""
    order = np.lexsort((docs, pairs))
    pairs, docs, counts = pairs[order], docs[order], counts[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    for x, y in zip(starts.tolist(), np.append(starts[1:], len(pairs)).tolist()):
        yield int(pairs[x]), y - x, int(counts[x:y].sum()), planes(docs[x:y], counts[x:y])


# --- the operator --------------------------------------------------------------

POSTING = ("pair", "documents", "links", "planes")


def _blocks_schema(kind: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([T.StructField("block", long), T.StructField("position", long), T.StructField("id", kind),
                         *[T.StructField(c, long) for c in DOC_COLUMNS], T.StructField("groups_sha256", T.StringType()),
                         T.StructField("pair", long), T.StructField("documents", long), T.StructField("links", long),
                         T.StructField("planes", T.ArrayType(T.BinaryType()))])


def encoded_blocks(docs: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of two kinds in numbered blocks: a document's figures (``position``
    is set) and a pair's postings (``pair`` is set)."""
    schema = _blocks_schema(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, tool = to_arrow_schema(schema), aligner(byte_path, piece_path)
        block, rows, size = TaskContext.get().partitionId() << 32, 0, 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow],
                schema=arrow)

        def postings() -> Iterator[pa.RecordBatch]:
            lists = _inverted(*map(np.concatenate, zip(*found)))
            part: list[tuple] = []
            for item in lists:
                part.append(item)
                if len(part) == 8192:
                    yield batch_of(len(part), block=[block] * len(part), **dict(zip(POSTING, zip(*part))))
                    part = []
            if part:
                yield batch_of(len(part), block=[block] * len(part), **dict(zip(POSTING, zip(*part))))

        for batch in batches:
            for lo, hi, data, _ in text_slices(batch.column(1)):
                if rows and (size + len(data) > BLOCK_BYTES or rows + hi - lo > BLOCK_ROWS):
                    yield from postings()
                    block, rows, size, found = block + 1, 0, 0, []
                for x in range(lo, hi, BLOCK_ROWS):  # many empty texts are a slice, too
                    y = min(x + BLOCK_ROWS, hi)
                    if x > lo:
                        yield from postings()
                        block, rows, size, found = block + 1, 0, 0, []
                    figures, pairs, texts, counts = align(tool, batch.column(1).slice(x, y - x).to_pylist())
                    found.append((pairs, (texts + rows).astype(np.int32), counts.astype(np.int32)))
                    yield batch_of(y - x, block=[block] * (y - x), position=range(rows, rows + y - x),
                                   id=batch.column(0).slice(x, y - x), **figures)
                    rows, size = rows + y - x, size + len(data)
        if rows:
            yield from postings()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, a, b, documents, links, best) over the whole corpus; ``best``:
    no pair of the same A id is in more documents."""
    merged = (postings.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
              .withColumn("a", F.shiftright("pair", B_BITS))
              .withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1)))
    highest = F.max("documents").over(Window.partitionBy("a"))
    return merged.withColumn("best", (F.col("documents") == highest).cast("long"))


def _scored(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Add up the scores of each block's postings at its documents."""
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in DOC_COLUMNS],
                           T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        best = total = np.zeros(0, np.int64)

        def finished() -> Iterator[pa.RecordBatch]:
            for p in parts:
                at = p.column("position").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [p.column("id"), *[p.column(c) for c in DOC_COLUMNS], pa.array(best[at]), pa.array(total[at]),
                     p.column("groups_sha256")], names=schema.names)

        for batch in batches:
            numbers = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for x, y in zip(edges[:-1], edges[1:]):
                if numbers[x:x + 1].tolist() != [block]:
                    yield from finished()
                    block, parts = numbers[x], []
                    best, total = np.zeros(BLOCK_ROWS, np.int64), np.zeros(BLOCK_ROWS, np.int64)
                part = batch.slice(x, y - x)
                split = part.num_rows - part.column("position").null_count  # documents come first
                if split:
                    parts.append(part.slice(0, split))
                part = part.slice(split)
                for levels, score, top in zip(part.column("planes").to_pylist(), part.column("score").to_pylist(),
                                              part.column("best").to_pylist()):
                    for k, data in enumerate(levels):
                        at = positions(data)
                        total[at] += score << k
                        best[at] += top << k
        yield from finished()

    return rows.mapInArrow(run, schema)


def aligned(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
            byte_path: str | None = None, piece_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): per document ``id``, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256; per linked id pair its corpus counts."""
    byte_path = byte_path or public_tokenizers.path(BYTE_VOCABULARY)
    piece_path = piece_path or public_tokenizers.path(PIECE_VOCABULARY)
    blocks = stored(encoded_blocks(docs, id_col, text_col, byte_path, piece_path), folder, "blocks")
    postings = blocks.where("pair IS NOT NULL").select("block", *POSTING)
    pairs = stored(pair_counts(postings.drop("planes")), folder, "pairs")
    kind = docs.schema[id_col].dataType
    figures = ["position", "id", *DOC_COLUMNS, "groups_sha256"]
    back = (postings.select("block", "pair", "planes")
            .join(pairs.select("pair", F.col("documents").alias("score"), "best"), "pair")
            .select("block", *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in figures],
                    "planes", "score", "best"))
    rows = blocks.where("position IS NOT NULL").select(
        "block", *figures, *[F.lit(None).cast(t).alias(c) for c, t in
                             [("planes", "array<binary>"), ("score", "long"), ("best", "long")]])
    together = (rows.unionByName(back).repartition("block")
                .sortWithinPartitions("block", F.col("position").asc_nulls_last()))
    return _scored(together, kind), pairs
