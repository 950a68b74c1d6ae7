"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to ORDER bytes with a count for
every symbol that follows.  A symbol is predicted in the longest context that
was seen; if it is new there, an escape is coded (method D: every first
occurrence gives half a count to the escape) and the next shorter context is tried without the symbols
just excluded, down to the uniform order -1.  The score of a text is the
log10 probability of its tokens joined by one space and an end symbol, with
A-Z lower-cased: what separates two words costs one space, whatever it is.

Spark form.  A symbol with its ORDER context bytes is a gram: a 48-bit key.
The probability of a symbol depends on its gram alone, so

1. texts are stored in blocks, cut where a task's running bytes reach
   BLOCK_BYTES (a longer text is a block of its own), and every block emits
   its distinct grams and words with their counts in training documents;
2. the counts are added up per key: this is the trie, as a table that grows
   with the corpus.  Log probabilities are computed in groups of whole
   three-byte contexts (the three bytes before the symbol): these hold the
   subtries of orders 5 to 3, at most 2^24 grams a context.  Order 2 comes as
   a counted table, at most 256 rows a context; the orders 1 and 0 are
   256 x 256 counts.  The number of groups follows the number of grams;
3. each block receives the values of its own keys only, and sums them per
   document.  No task ever holds the whole trie, and nothing is broadcast
   but the 65,536 counts of order 1.

``adaptive_scores`` is the other mode: every text is coded by a trie that
begins empty and learns as it goes.

Defined results: a null or empty text has the end symbol only; a null id
counts as the empty text in the fold; equal rows are scored alike; without
training documents every symbol has probability 1/256 and c, N and V are 0;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.common import blank, lower_ascii, span_hash, spans, stored, text_slices

ORDER = 5
END = 0xFF  # never a byte of UTF-8
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 40 << 20
#: Bytes that a worker turns into arrays at once, of one text or of many.
SLICE = 1 << 19
#: Grams that a group of contexts has on average.
GROUP_GRAMS = 1 << 18
#: Words longer than this are hashed one by one.
LONG_WORD = 1 << 16
#: Rows of an Arrow batch of keys.
OUT_ROWS = 1 << 17
#: Words are keyed by 63-bit hashes with the sign bit set; the end token has a key of its own.
WORD_BIT, END_KEY = np.uint64(1 << 63), np.uint64(1 << 63)


# --- a block of texts ---------------------------------------------------------

class Block:
    """Texts as one byte array: ORDER ends, the words joined by spaces, an end.
    ``grams`` and ``words`` go over it in bounded parts, also within a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = lower_ascii(data)
        keep = ~blank(data)
        starts, ends, rows = spans(keep, offsets)
        self.n_tokens = np.bincount(rows, minlength=len(offsets) - 1) + 1
        inner = ends[:-1][rows[:-1] == rows[1:]]  # the blank behind a word that is not its text's last
        keep[inner] = True
        data[inner] = 32
        kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
        n = np.arange(len(offsets))
        self.offsets = kept + n * (ORDER + 1)
        self.data = np.full(int(self.offsets[-1]), END, np.uint8)
        inside = np.ones(len(self.data), bool)
        for j in range(ORDER):
            inside[self.offsets[:-1] + j] = False
        inside[self.offsets[1:] - 1] = False
        self.data[inside] = data[keep]

    def _ranges(self) -> Iterator[tuple[int, int]]:
        """Ranges of whole texts of some SLICE bytes; a longer text alone."""
        lo, n = 0, len(self.offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + 2 * SLICE, "right")) - 1)
            yield lo, min(hi, n)
            lo = hi

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(keys, first of each text, first text) of all predicted symbols;
        a long text comes in several parts."""
        for lo, hi in self._ranges():
            begin, end = int(self.offsets[lo]), int(self.offsets[hi])
            for x in range(begin, end - ORDER, 2 * SLICE) if hi == lo + 1 else [begin]:
                part = self.data[x:min(x + 2 * SLICE, end - ORDER) + ORDER if hi == lo + 1 else end]
                n = len(part) - ORDER
                keys = np.zeros(n, np.int64)
                for j in range(ORDER + 1):
                    keys <<= 8
                    keys |= part[j:n + j]
                if hi == lo + 1:
                    yield keys, np.zeros(1, np.int64), lo
                    continue
                # A gram that ends inside the leading ends of the next text is no prediction.
                at = self.offsets[lo:hi + 1] - begin
                real = np.ones(n, bool)
                for j in range(ORDER):
                    real[at[1:-1] - ORDER + j] = False
                yield keys[real], np.concatenate([[0], np.cumsum(np.diff(at) - ORDER)])[:-1], lo

    def words(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(keys, first token of each text, first text) of all words and ends."""
        for lo, hi in self._ranges():
            at = self.offsets[lo:hi + 1]
            if hi > lo + 1:
                part = self.data[at[0]:at[-1]]
                starts, ends, rows = spans((part != 32) & (part != END), at - at[0])
                first = np.concatenate([[0], np.cumsum(self.n_tokens[lo:hi])])
                keys = np.full(int(first[-1]), END_KEY, np.uint64)
                keys[np.arange(len(starts)) + rows] = _word_keys(part, starts, ends)  # one end token per earlier text
                yield keys.view(np.int64), first[:-1], lo
                continue
            x, stop, none = int(at[0]) + ORDER, int(at[1]) - 1, np.zeros(1, np.int64)
            while x < stop:  # from one space to another
                y = min(x + 2 * SLICE, stop)
                while y < stop and not (space := np.flatnonzero(self.data[y:y + SLICE] == 32)).size:
                    y = min(y + SLICE, stop)
                y = stop if y >= stop else y + int(space[0])
                part = self.data[x:y]
                starts, ends, _ = spans(part != 32, np.array([0, len(part)]))
                yield _word_keys(part, starts, ends).view(np.int64), none, lo
                x = y + 1
            yield np.array([END_KEY]).view(np.int64), none, lo


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of words; one longer than LONG_WORD is hashed by itself."""
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long) == 0:
        return (span_hash(data, starts, ends) >> np.uint64(1)) + np.uint64(1) | WORD_BIT
    keys = np.empty(len(starts), np.uint64)
    for i in long.tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        keys[i] = (int.from_bytes(digest, "little") >> 1) + 1 | int(WORD_BIT)
    edges = np.concatenate([[-1], long, [len(starts)]])
    for x, y in zip(edges[:-1] + 1, edges[1:]):  # the words between two long ones
        if x < y:
            lo = starts[x]
            own = data[lo:ends[y - 1]]
            keys[x:y] = (span_hash(own, starts[x:y] - lo, ends[x:y] - lo) >> np.uint64(1)) + np.uint64(1) | WORD_BIT
    return keys


def _parts(column: pa.Array) -> Iterator[tuple[int, int, Block]]:
    """Blocks of bounded size over a string column (a longer text alone)."""
    for lo, hi, data, offsets in text_slices(column, SLICE):
        yield lo, hi, Block(data, offsets)


def keyed(docs: DataFrame, id_col: str, text_col: str, training: Column, folder: str) -> DataFrame:
    """(id, text, train, block), stored: a task's rows in the order read, a
    new block whenever the next text would pass BLOCK_BYTES.  Splits of less
    than a block are read together: what many texts share is then one key."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(training, F.lit(False)).alias("train"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(1, -(-total // BLOCK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for n in pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist():
                if size and size + n > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += n
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())],
                                             names=["id", "text", "train", "block"])

    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])
    return stored(rows.mapInArrow(run, schema), folder, "texts")


class Counts:
    """Adds up counts of keys, piece by piece, in bounded memory: pieces are
    merged with others of their size, so little more than two tables exist."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, count: bool = True) -> None:
        if len(keys) == 0:
            return
        u, n = np.unique(keys, return_counts=True)
        self.held.append((u, (n if count else np.zeros_like(n)).astype(np.int32)))
        while len(self.held) > 1 and len(self.held[-1][0]) * 2 > len(self.held[-2][0]):
            self._join_last()

    def _join_last(self) -> None:
        (ka, na), (kb, nb) = self.held[-2:]
        del self.held[-2:]
        keys, n = np.concatenate([ka, kb]), np.concatenate([na, nb])
        del ka, kb, na, nb
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.held.append((keys[first], np.add.reduceat(n, first)))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.held) > 1:
            self._join_last()
        return self.held[0] if self.held else (np.empty(0, np.int64), np.empty(0, np.int32))


def block_keys(rows: DataFrame) -> DataFrame:
    """(block, key, n): the distinct grams and words of every block with
    their counts in training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at = Counts(), None

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = counts.merged()
            for x in range(0, len(keys), OUT_ROWS):
                k = keys[x:x + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), at)), pa.array(k), pa.array(n[x:x + OUT_ROWS].astype(np.int64))],
                    names=["block", "key", "n"])

        for batch in batches:
            blocks = batch.column(2).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if counts.held and blocks[a] != at:
                    yield from out()
                    counts = Counts()
                at = blocks[a]
                part = batch.slice(a, b - a)
                for train in (True, False):
                    rows = part.filter(pa.array(part.column(1).to_numpy(zero_copy_only=False) == train))
                    for _, _, texts in _parts(rows.column(0)):
                        for keys, _, _ in texts.grams():
                            counts.add(keys, train)
                        for keys, _, _ in texts.words():
                            counts.add(keys, train)
        if counts.held:
            yield from out()

    return rows.select("text", "train", "block").mapInArrow(run, "block long, key long, n long")


# --- the model -------------------------------------------------------------------

def low_orders(grams: DataFrame) -> np.ndarray:
    """Counts of (byte, symbol): 256 x 256 numbers on the driver."""
    out = np.zeros((256, 256))
    for r in (grams.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("k"))
              .agg(F.sum("n").alias("n")).collect()):
        out[r.k >> 8, r.k & 255] = r.n
    return out


def log_probabilities(keys: np.ndarray, n: np.ndarray, second: tuple[np.ndarray, np.ndarray],
                      pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's symbol in its context.

    ``keys``/``n``: all grams that share their last three context bytes with
    any of them, with training counts (0: only to be predicted); ``second``:
    (three context bytes and a symbol, count of order 2) for all symbols that
    follow the last two of the bytes, sorted; ``pairs``: the counts of order 1."""
    symbol = keys & 255
    node, total, kinds, count = {}, {}, {}, {}
    for k in range(ORDER, 2, -1):
        _, pair, at = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_index=True, return_inverse=True)
        c = np.bincount(at, n, len(pair))
        context, node_of = np.unique((keys[pair] >> 8) & ((1 << 8 * k) - 1), return_inverse=True)
        node[k], count[k] = node_of[at], c[at]
        total[k] = np.bincount(node_of, c, len(context))
        kinds[k] = np.bincount(node_of, c > 0, len(context))
        node[k, "pairs"] = pair, node_of, c > 0
    # Order 2: a node for each context of three bytes, which share what follows the last two.
    three, follows = second
    context = np.unique((keys >> 8) & 0xFFFFFF)
    node[2] = np.searchsorted(context, (keys >> 8) & 0xFFFFFF)
    owner = np.searchsorted(context, three >> 8)
    total[2] = np.bincount(owner, follows, len(context)).astype(float)
    kinds[2] = np.bincount(owner, minlength=len(context)).astype(float)
    at = np.minimum(np.searchsorted(three, keys & 0xFFFFFFFF), max(len(three) - 1, 0))
    count[2] = np.where(three[at] == keys & 0xFFFFFFFF, follows[at], 0.0) if len(three) else np.zeros(len(keys))
    before = (keys >> 8) & 255
    single = pairs.sum(0)
    count[1], count[0] = pairs[before, symbol], single[symbol]
    total[1], kinds[1] = pairs.sum(1), (pairs > 0).sum(1).astype(float)
    node[1], node[0] = before, np.zeros(len(keys), np.int64)
    total[0], kinds[0] = np.array([single.sum()]), np.array([float((single > 0).sum())])

    def excluded(k: int) -> np.ndarray:
        """Per context of order k + 1: counts in order k of the symbols it has."""
        if k > 1:
            pair, node_of, seen = node[k + 1, "pairs"]
            return np.bincount(node_of, np.where(seen, count[k][pair], 0.0), len(total[k + 1]))
        if k == 1:
            return np.bincount(owner, pairs[(three >> 8) & 255, three & 255], len(context))
        return (pairs > 0) @ single

    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    for k in range(ORDER, -1, -1):
        at = node[k]
        n_k, q_k = total[k][at], kinds[k][at]
        if k < ORDER:
            up = node[k + 1]
            n_k, q_k = n_k - excluded(k)[up], q_k - kinds[k + 1][up]
        whole = 2 * n_k
        seen = open_ & (whole > 0)
        hit = seen & (count[k] > 0)
        out[hit] += np.log10((2 * count[k][hit] - 1) / whole[hit])
        miss = seen & (count[k] == 0)
        out[miss] += np.log10(q_k[miss] / whole[miss])
        open_ &= ~hit
    out[open_] -= math.log10(256 - kinds[0][0])
    return out


def model_values(totals: DataFrame) -> DataFrame:
    """(key, value) of all keys: log10 probability of a gram, count of a word."""
    grams = totals.where("key >= 0")
    pairs = low_orders(grams)
    groups = max(64, grams.count() // GROUP_GRAMS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, n = table["key"].to_numpy(), table["n"].to_numpy()
        own = keys >= 0
        three = -keys[~own] - 1
        order = np.argsort(three)
        second = three[order], n[~own][order].astype(float)
        keys = keys[own]
        return pa.table({"key": keys, "value": log_probabilities(keys, n[own].astype(float), second, pairs)
                         if len(keys) else np.empty(0)})

    # What follows two bytes goes to every context of three that ends in them, marked by a negative key.
    two = (grams.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("two")).agg(F.sum("n").alias("n"))
           .withColumn("tail", F.shiftright("two", 8)))
    three = grams.select(F.shiftright("key", 8).bitwiseAND(0xFFFFFF).alias("three")).distinct()
    marks = (three.withColumn("tail", F.col("three").bitwiseAND(0xFFFF)).join(two, "tail")
             .select((-(F.shiftleft("three", 8) + F.col("two").bitwiseAND(255)) - 1).alias("key"), "n",
                     F.col("three").alias("c")))
    group = F.pmod(F.xxhash64("c"), F.lit(groups))
    scored = (grams.withColumn("c", F.shiftright("key", 8).bitwiseAND(0xFFFFFF)).unionByName(marks)
              .select("key", "n", group.alias("g")).groupBy("g").applyInArrow(run, "key long, value double"))
    return scored.union(totals.where("key < 0").select("key", F.col("n").cast("double")))


# --- scores ---------------------------------------------------------------------

def pretrained_scores(docs: DataFrame, training: Column, folder: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of
    every document; ``training`` marks the documents to learn from."""
    rows = keyed(docs, id_col, text_col, training, folder)
    # Keys come in order: differences are stored.
    keys = stored(block_keys(rows), folder, "keys", **{"parquet.writer.version": "v2"})
    totals = stored(keys.groupBy("key").agg(F.sum("n").alias("n")), folder, "totals")
    known = totals.where("key < 0 AND n > 0").agg(F.sum("n"), F.count("*")).first()
    n_train, n_kinds = int(known[0] or 0), int(known[1])
    values = model_values(totals)
    # A word whose training places are all in this block needs no exchange.
    needed = keys.join(values, "key").where("key >= 0 OR n <> value").select("block", "key", "value")
    id_type = docs.schema[id_col].dataType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Counts()
        for batch in left.to_batches():
            learned = batch.column("text").filter(batch.column("train"))
            for _, _, part in _parts(learned):
                for k, _, _ in part.words():
                    own.add(k)
        own_keys, own_n = own.merged()
        # Values from elsewhere come first: they are of the whole corpus.
        keys, first = np.unique(np.concatenate([right["key"].to_numpy(), own_keys]), return_index=True)
        value = np.concatenate([right["value"].to_numpy(), own_n.astype(float)])[first]
        del first, own_keys, own_n, own
        table = pd.Index(keys)

        def of(k: np.ndarray, missing: float | None = None) -> np.ndarray:
            at = table.get_indexer(k)
            if missing is None and len(at) and at.min() < 0:
                raise ValueError("a gram of the block has no value")
            return np.where(at < 0, 0.0 if missing is None else missing, value[at])

        tokens, hits, base, score = [], [], [], []
        for part in (p for batch in left.to_batches() for _, _, p in _parts(batch.column("text"))):
            n = len(part.n_tokens)
            tokens.append(part.n_tokens)
            for out, kind in ((hits, np.int64), (base, float), (score, float)):
                out.append(np.zeros(n, kind))
            for k, first, lo in part.words():
                c = of(k, 0.0)
                hits[-1][lo:lo + len(first)] += np.add.reduceat((c > 0).astype(np.int64), first)
                share = (c + 0.5) / (n_train + 0.5 * (n_kinds + 1))
                base[-1][lo:lo + len(first)] += np.add.reduceat(np.log10(share), first)
            for k, first, lo in part.grams():
                score[-1][lo:lo + len(first)] += np.add.reduceat(of(k), first)
        return pa.table([left["id"], left["train"], np.concatenate(tokens), np.concatenate(hits),
                         np.full(left.num_rows, n_train), np.concatenate(base), np.concatenate(score)], names=names)

    names = ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = T.StructType([T.StructField("id", id_type), T.StructField("train", T.BooleanType())]
                          + [T.StructField(n, T.LongType()) for n in names[2:5]]
                          + [T.StructField(n, T.DoubleType()) for n in names[5:]])

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows else pa.table(
            {f.name: pa.array([], t) for f, t in zip(schema.fields, [left.schema.field("id").type, pa.bool_(),
             pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])})

    return rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(whole, schema)


# --- the adaptive mode -----------------------------------------------------------

class Trie:
    """Contexts of up to ORDER bytes with the counts of their next symbols."""

    def __init__(self) -> None:
        self.next: dict[bytes, dict[int, int]] = {}

    def log10(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, frozenset()
        for k in range(ORDER, -1, -1):
            counts = self.next.get(context[len(context) - k:])
            if not counts:
                continue
            left = {s: c for s, c in counts.items() if s not in excluded}
            whole = 2 * sum(left.values())
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / whole)
            if left:
                out += math.log10(len(left) / whole)
            excluded = frozenset(counts)
        return out - math.log10(256 - len(excluded))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(ORDER + 1):
            counts = self.next.setdefault(context[len(context) - k:], {})
            counts[symbol] = counts.get(symbol, 0) + 1


def adaptive_score(text: str | None, trie: Trie | None = None, learn: bool = True) -> float:
    """log10 probability of one text by a trie that learns while it reads."""
    trie = Trie() if trie is None else trie
    data = bytes([END]) * ORDER + b" ".join((text or "").encode().lower().split()) + bytes([END])
    out = 0.0
    for i in range(ORDER, len(data)):
        out += trie.log10(data[i - ORDER:i], data[i])
        if learn:
            trie.learn(data[i - ORDER:i], data[i])
    return out


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): every text by itself, coded adaptively."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [adaptive_score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
