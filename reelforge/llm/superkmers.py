"""Repeated passages: exact windows of words by super-k-mer partitioning.

A window is ``window`` consecutive words of one text; its minimiser is the
smallest hash among its runs of ``core`` words, and the hash names a bucket.
Consecutive windows that share a minimiser travel as one packed string (a
super-k-mer: all their words, joined by one space) to that bucket.  There the
words become exact numbers, windows exact numbers by doubling (pairs of pairs,
each time sorted), and sorting by (window, document) shows the smallest
document of each window.  Every equal window, wherever it lies, has the same
minimiser, so a bucket sees all of its copies.

Skew.  Within some MB of texts a task sends an equal string once, for the
smallest document that has it; its other documents are settled there (all of
the string's windows also start in a smaller document).  Buckets are counted
over all texts first; super-k-mers of a bucket with more than CROWDED times the
mean travel window by window, dealt by the window's own hash.  A window's
place depends on its words alone, so nothing is lost, and what remains of a
passage in very many documents is a string for each flush.  There are fewer
than 1 / CROWDED times as many crowded buckets as buckets (a list in every
task), and buckets follow the bytes of the table.

Defined results: a null or empty text has no words; a null id counts as larger
than every other; rows of one id are no smaller documents for each other and
keep a result each; texts of any length are taken whole (in runs of words that
overlap by a window); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.llm.common import blank, mix64, span_hash, spans, text_slices, window_hash

WINDOW, CORE = 13, 3
#: Text whose super-k-mers are in one bucket on average; buckets at least.
BUCKET_BYTES, LEAST_BUCKETS = 6 << 20, 64
#: A bucket with this many times the mean is dealt window by window.
CROWDED = 4
#: A task gathers super-k-mers of so much text before it sends them.
FLUSH_BYTES = 12 << 20
#: Words handled at once in a long text.
STEP = 1 << 17
NO_ID = (1 << 63) - 1  # stands for a null id, after all others

SPAN = "doc long, mark long, first long, after long"


# --- windows and minimisers of one slice -------------------------------------

def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_minimisers(words: np.ndarray, rows: np.ndarray, window: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimiser) of every window inside one row."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(rows[:len(rows) - window + 1] == rows[window - 1:])
    at, hashes = window_hash(words, rows, core)
    cores = np.full(len(words) - core + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    cores[at] = hashes
    return first, _sliding_min(cores, window - core + 1)[first]


def _chunks(column: pa.Array, window: int) -> Iterator[tuple]:
    """(row offset, bytes, word starts, word ends, rows, first word, words of
    each row before) in runs of words that overlap by a window less one."""
    for lo, _, data, at in text_slices(column):
        starts, ends, rows = spans(~blank(data), at)
        begin = np.searchsorted(rows, np.arange(len(at)))
        for x in range(0, len(starts), STEP):
            y = min(x + STEP + window - 1, len(starts))
            if y - x >= window:
                yield lo, data, starts[x:y], ends[x:y], rows[x:y], x, begin


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words' bytes with one space behind each, and their new places."""
    lo, hi = int(starts[0]), int(ends[-1])
    part = data[lo:hi]
    is_blank = blank(part)
    keep = ~is_blank
    keep[1:] |= ~is_blank[:-1]
    place = np.cumsum(keep) - 1
    out = np.where(is_blank, np.uint8(32), part)[keep]
    return out.tobytes(), place[starts - lo], place[ends - lo - 1] + 1


# --- sending --------------------------------------------------------------------

def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(hashes) % np.uint64(buckets)).astype(np.int64)


def _runs(words: np.ndarray, rows: np.ndarray, window: int, core: int, buckets: int,
          crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first word, last window's first word) of every super-k-mer."""
    first, least = window_minimisers(words, rows, window, core)
    if len(first) == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    bucket = _bucket_of(least, buckets)
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) != 1) | (least[1:] != least[:-1])
    alone = np.isin(bucket, crowded) if len(crowded) else np.zeros(len(first), bool)
    if alone.any():
        at = first[alone]
        own = np.full(len(at), np.uint64(window))
        for j in range(window):
            own = mix64(own * np.uint64(0x9E3779B97F4A7C15) + words[at + j])
        bucket[alone] = _bucket_of(own, buckets)
        new |= alone
        new[1:] |= alone[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(first)) - 1
    return bucket[head], first[head], first[last]


def bucket_words(texts: DataFrame, window: int, core: int, buckets: int) -> DataFrame:
    """(bucket, words) over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for _, data, starts, ends, rows, _, _ in _chunks(batch.column("text"), window):
                bucket, a, z = _runs(span_hash(data, starts, ends), rows, window, core, buckets, np.empty(0))
                at, where = np.unique(bucket, return_inverse=True)
                for b, n in zip(at.tolist(), np.bincount(where, z - a + window).astype(np.int64).tolist()):
                    total[b] = total.get(b, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         names=["bucket", "words"])

    return (texts.select("text").mapInArrow(run, "bucket long, words long")
            .groupBy("bucket").agg(F.sum("words").alias("words")))


def _merged(doc, mark, first, after) -> list[np.ndarray]:
    """Overlapping or touching spans of one text become one."""
    order = np.lexsort((first, mark, doc))
    doc, mark, first, after = doc[order], mark[order], first[order], after[order]
    if len(doc) == 0:
        return [doc, mark, first, after]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    text = np.cumsum(other)
    base = text * (int(after.max()) + 2)  # so that a running maximum stays within a text
    reach = np.maximum.accumulate(after + base)
    new = np.ones(len(doc), bool)
    new[1:] = (first + base)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return [doc[head], mark[head], first[head], (reach - base)[last]]


def super_kmers(texts: DataFrame, window: int, core: int, buckets: int, crowded: np.ndarray) -> DataFrame:
    """Rows of (bucket, strings, docs, places): a flush's distinct strings of a
    bucket, the document of each, and (string, mark, first word) of each of
    its places; rows without strings are spans that are already settled."""
    names = ["bucket", "strings", "docs", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(6)
        strings: list[bytes] = []
        heads: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, doc, mark, first, count = map(np.concatenate, zip(*heads))
            code = np.asarray(pa.array(strings, pa.large_binary()).dictionary_encode().indices).astype(np.int64)
            least = np.full(int(code.max()) + 1, NO_ID)
            np.minimum.at(least, code, doc)
            settled = doc > least[code]
            out = []
            if settled.any():
                spans_ = _merged(doc[settled], mark[settled], first[settled],
                                 first[settled] + count[settled] + window - 1)
                raw = np.stack(spans_).astype("<i8").tobytes()
                out.append((int(mix64(spans_[1][:1].view(np.uint64))[0] % np.uint64(buckets)), None, None,
                            pack.compress(raw)))
            at = np.flatnonzero(~settled)
            at = at[np.lexsort((code[at], bucket[at]))]
            edges = np.flatnonzero(np.diff(bucket[at], prepend=-1))
            for x, y in zip(edges.tolist(), np.append(edges[1:], len(at)).tolist()):
                rows = at[x:y]
                new = np.flatnonzero(np.diff(code[rows], prepend=-1))
                which = np.cumsum(np.diff(code[rows], prepend=-1) != 0) - 1
                out.append((int(bucket[rows[0]]), pack.compress(b"\n".join([strings[i] for i in rows[new].tolist()])),
                            pack.compress(doc[rows[new]].astype("<i8").tobytes()),
                            pack.compress(np.stack([which, mark[rows], first[rows]]).astype("<i8").tobytes())))
                if len(out) >= 512:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(rows) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for lo, data, starts, ends, rows, offset, begin in _chunks(batch.column("text"), window):
                words = span_hash(data, starts, ends)
                bucket, a, z = _runs(words, rows, window, core, buckets, crowded)
                if len(a) == 0:
                    continue
                raw, at, to = _packed(data, starts, ends)
                strings += [raw[x:y] for x, y in zip(at[a].tolist(), to[z + window - 1].tolist())]
                row = rows[a]
                heads.append((bucket, ids[lo + row], marks[lo + row], a + offset - begin[row], z - a + 1))
                size += len(raw)
                if size >= FLUSH_BYTES:
                    yield from flush()
                    strings, heads, size = [], [], 0
        if heads:
            yield from flush()

    return texts.mapInArrow(run, "bucket long, strings binary, docs binary, places binary")


# --- buckets ---------------------------------------------------------------------

def window_numbers(codes: np.ndarray, window: int) -> np.ndarray:
    """A number for each run of ``window`` codes, equal for equal runs: two
    neighbours of half the length, sorted, make a number of the whole."""
    def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.unique(x * (int(y.max()) + 1) + y, return_inverse=True)[1].astype(np.int64)

    size = 1
    while size * 2 <= window:
        codes, size = paired(codes[:-size], codes[size:]), size * 2
    rest = window - size
    return paired(codes[:-rest], codes[rest:]) if rest else codes


def _word_codes(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact word numbers, index of the first word of each string)."""
    at = np.flatnonzero(separator)
    sizes = np.diff(np.concatenate([[-1], at, [len(data)]])) - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes),
                                             [None, pa.py_buffer(offsets), pa.py_buffer(data[~separator].tobytes())])
    codes = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    return codes, np.concatenate([[0], np.flatnonzero(data[at] == 10) + 1])


def repeated_spans(parts: list[tuple[bytes, bytes, bytes]], window: int) -> list[np.ndarray]:
    """(doc, mark, first, after) of the runs of a bucket's windows that also
    start in a smaller document."""
    unpack = zstandard.ZstdDecompressor().decompress
    data = np.frombuffer(b"\n".join(unpack(s) for s, _, _ in parts), np.uint8)
    docs = [np.frombuffer(unpack(d), "<i8") for _, d, _ in parts]
    places = [np.frombuffer(unpack(p), "<i8").reshape(3, -1) for _, _, p in parts]
    before = np.cumsum([0, *map(len, docs)])
    which = np.concatenate([p[0] + n for p, n in zip(places, before)])
    mark, first = (np.concatenate([p[k] for p in places]) for k in (1, 2))
    doc = np.concatenate(docs)
    codes, begin = _word_codes(data, (data == 32) | (data == 10))
    string = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(codes))))
    at = np.flatnonzero(string[:len(string) - window + 1] == string[window - 1:])
    numbers, owner = window_numbers(codes, window)[at], doc[string[at]]
    order = np.lexsort((owner, numbers))
    new = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    least = np.repeat(owner[order][new], np.diff(np.append(new, len(order))))
    gone = np.zeros(len(at), bool)
    gone[order] = owner[order] > least
    at = at[gone]
    if len(at) == 0:
        return [np.empty(0, np.int64)] * 4
    split = np.ones(len(at), bool)
    split[1:] = (np.diff(at) != 1) | (string[at[1:]] != string[at[:-1]])
    head = np.flatnonzero(split)
    x, y, own = at[head], at[np.append(head[1:], len(at)) - 1] + window, string[at[head]]
    # Every place of a string gets the string's spans.
    order = np.argsort(which, kind="stable")
    of = np.searchsorted(which[order], own)
    n = np.searchsorted(which[order], own, "right") - of
    span = np.repeat(np.arange(len(own)), n)
    place = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(of, n)]
    shift = first[place] - begin[own[span]]
    return [doc[own[span]], mark[place], x[span] + shift, y[span] + shift]


def bucket_spans(packed: DataFrame, window: int) -> DataFrame:
    """(doc, mark, first, after): word spans covered by windows that also
    start in a smaller document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        bucket, parts = None, []

        def table(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              names=["doc", "mark", "first", "after"])

        for batch in batches:
            for b, s, d, p in zip(*(batch.column(k).to_pylist() for k in ("bucket", "strings", "docs", "places"))):
                if s is None:
                    yield table(np.frombuffer(unpack(p), "<i8").reshape(4, -1))
                    continue
                if b != bucket and parts:
                    yield table(repeated_spans(parts, window))
                    parts = []
                bucket = b
                parts.append((s, d, p))
        if parts:
            yield table(repeated_spans(parts, window))

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPAN)


# --- the operator -----------------------------------------------------------------

def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, text); the mark tells rows of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("mark"), text.alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     core: int = CORE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, mark, first, after): spans of words whose windows also start in a
    document with a smaller id; spans of one text may overlap."""
    texts = _texts(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // bucket_bytes)
    counts = bucket_words(texts, window, core, buckets)
    mean = counts.agg(F.sum("words") / F.lit(buckets)).first()[0] or 0.0
    crowded = np.array([r.bucket for r in counts.where(F.col("words") > CROWDED * mean).select("bucket").collect()],
                       np.int64)
    return bucket_spans(super_kmers(texts, window, core, buckets, crowded), window)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    core: int = CORE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: ``kept`` are its words
    outside repeated windows, joined by one space."""
    schema = "id long, n_words long, n_removed long, kept binary"
    found = repeated_windows(docs, id_col, text_col, window, core, bucket_bytes)
    spans_ = found.select("doc", "mark", "first", "after", F.lit(None).cast("string").alias("text"))
    texts = _texts(docs, id_col, text_col).select("doc", "mark", F.lit(None).cast("long").alias("first"),
                                                  F.lit(None).cast("long").alias("after"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        cover: list[tuple[int, int]] = []  # of the text whose rows come next
        for batch in batches:
            out = []
            for doc, mark, first, after, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, mark) != at:
                    at, cover = (doc, mark), []
                if text is None:
                    cover.append((first, after))
                    continue
                words = text.encode().split()  # bytes split at ASCII blanks only
                n = len(words)
                if cover:
                    edge = np.zeros(n + 1, np.int64)
                    x, y = np.array(cover).T
                    np.add.at(edge, x, 1)
                    np.add.at(edge, y, -1)
                    keep = np.flatnonzero(np.cumsum(edge)[:n] == 0).tolist()
                    words = [words[i] for i in keep]
                out.append((None if doc == NO_ID else doc, n, n - len(words), b" ".join(words)))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                                                 names=["id", "n_words", "n_removed", "kept"])

    return (spans_.unionByName(texts).repartition("doc", "mark")
            .sortWithinPartitions("doc", "mark", F.col("text").isNotNull())
            .select("doc", "mark", "first", "after", "text").mapInArrow(run, schema))

