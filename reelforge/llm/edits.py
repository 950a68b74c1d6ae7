"""Edit-aware token counts.

Every document keeps a segment tree over pieces of its text.  Pieces begin at
safe cuts: a single blank between two dark characters always begins a new
pre-token, whatever stands on either side, so the token count of a text is the
sum over its pieces, and a piece can be encoded without the rest.

An edit replaces the characters [start, end).  Only the pieces that it touches
are encoded again, joined with a neighbour while the cut between them is no
longer safe (the boundary context); then the sums on the paths from these
leaves to the root are updated.  A tree keeps its number of leaves: a run of
pieces is cut again into as many as it had, some of them empty.

Trees are columns (``leaf_chars``: characters per leaf; ``tree``: sums in heap
order, the root at 1), so they are stored with the documents, and edits meet
their document by a join.

Defined results: a null text is empty and has no tokens (one empty leaf);
null or no edits change nothing; edits are sorted, clipped to the text, and
one that overlaps an earlier one is moved to begin where that ends; a null replacement is empty; equal
rows are handled alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.tokens import encoder, vocabulary_path

PIECE_CHARS = 512
BATCH_CHARS = 1 << 21
EDIT = "array<struct<start:int,end:int,replacement:string>>"


def safe(left: str, right: str) -> bool:
    """Whether a text may be cut between ``left`` and ``right``."""
    return bool(left) and not left[-1].isspace() and right[:1] == " " and len(right) > 1 and not right[1].isspace()


def pieces(text: str, most: int | None = None) -> list[str]:
    """The text in pieces of about PIECE_CHARS, cut at safe places; ``most`` limits their number."""
    out, begin = [], 0
    while most is None or len(out) < most - 1:
        at = text.find(" ", begin + PIECE_CHARS)
        while at >= 0 and not safe(text[at - 1:at], text[at:at + 2]):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[begin:at])
        begin = at
    out.append(text[begin:])
    return out


def heap(counts: list[int]) -> list[int]:
    """Sums in heap order: leaf i is node len(counts) + i, the root node 1."""
    n = len(counts)
    tree = [0] * n + list(counts)
    for i in range(n - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def update(tree: list[int], leaf: int, count: int) -> None:
    """Set a leaf and add the difference on its path to the root."""
    i = len(tree) // 2 + leaf
    change = count - tree[i]
    while i >= 1 and change:
        tree[i] += change
        i //= 2


def tokens(tree: list[int]) -> int:
    return tree[1]


def clean_edits(edits, size: int) -> list[tuple[int, int, str]]:
    out, last = [], 0
    for e in sorted((e["start"] or 0, e["end"] or 0, e["replacement"] or "") for e in edits or [] if e):
        start = max(last, min(max(e[0], 0), size))
        end = max(start, min(e[1], size))
        out.append((start, end, e[2]))
        last = end
    return out


def touched(text: str, chars: list[int], edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of leaves (first, last + 1, their new text) to encode again."""
    begins = [0]
    for c in chars:
        begins.append(begins[-1] + c)
    starts = [e[0] for e in edits]
    runs: list[list[int]] = []
    leaf = 0
    for start, end, _ in edits:
        while leaf < len(chars) - 1 and begins[leaf + 1] < start:
            leaf += 1
        last = leaf
        while last < len(chars) - 1 and begins[last + 1] <= end:
            last += 1
        if runs and leaf <= runs[-1][1]:  # runs side by side are one
            runs[-1][1] = max(runs[-1][1], last + 1)
        else:
            runs.append([leaf, last + 1])

    def new_text(a: int, b: int) -> str:
        out, at = [], begins[a]
        for i in range(bisect_left(starts, begins[a]), bisect_right(starts, begins[b])):
            start, end, put = edits[i]
            if end <= begins[b] and (start < begins[b] or b == len(chars)):
                out += [text[at:start], put]
                at = end
        return "".join(out) + text[at:begins[b]]

    done: list[list] = []
    for a, b in runs:
        if done and a < done[-1][1]:
            a, b = done[-1][0], max(b, done[-1][1])
            done.pop()
        while True:
            own = new_text(a, b)
            if a > 0 and done and done[-1][1] == a:  # the run before ends here: one run
                a = done.pop()[0]
            elif a > 0 and not safe(text[begins[a] - 1:begins[a]], own):
                a -= 1
            elif b < len(chars) and not safe(own, text[begins[b]:begins[b] + 2]):
                b += 1
            else:
                break
        done.append([a, b, own])
    # Growing to the right may have reached the next run.
    return [tuple(x) for x in done]


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, text, leaf_chars, tree) of every whole text."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, texts in _groups(batch.column(1)):
                cut = [pieces(t) for t in texts]
                counts = iter(enc.count([p for ps in cut for p in ps]))
                trees = [heap([next(counts) for _ in ps]) for ps in cut]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)), pa.array(texts, pa.string()),
                     pa.array([[len(p) for p in ps] for ps in cut], pa.list_(pa.int32())),
                     pa.array(trees, pa.list_(pa.int32()))], names=["id", "text", "leaf_chars", "tree"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
                       ).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                                                       T.StructField("text", T.StringType()),
                                                       T.StructField("leaf_chars", T.ArrayType(T.IntegerType())),
                                                       T.StructField("tree", T.ArrayType(T.IntegerType()))]))


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits of an edit table (id, start, end, replacement)."""
    own = edits.groupBy("id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    return trees.join(own, "id", "left")


def apply_edits(trees: DataFrame, vocabulary: str | None = None, mask: tuple[str, str] | None = None) -> DataFrame:
    """(id, text, leaf_chars, tree, tokens_before, tokens_after, n_edits,
    leaves_encoded) after the column ``edits`` of ``trees``, or with ``mask``
    (pattern, replacement) after an edit for every match of the pattern."""
    path = vocabulary or vocabulary_path()
    if mask:
        trees = trees.withColumn("edits", F.lit(None).cast(EDIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, texts in _groups(batch.column(1)):
                part = batch.slice(lo, len(texts))
                chars, trees, edits = (part.column(i).to_pylist() for i in (2, 3, 4))
                if mask:
                    edits = [[dict(start=m.start(), end=m.end(), replacement=mask[1]) for m in re.finditer(mask[0], t)]
                             for t in texts]
                edits = [clean_edits(e, len(t)) for t, e in zip(texts, edits)]
                runs = [touched(t, c, e) if e else [] for t, c, e in zip(texts, chars, edits)]
                cut = [[pieces(own, b - a) for a, b, own in r] for r in runs]
                counts = iter(enc.count([p for r in cut for ps in r for p in ps]))
                rows = []
                for i, text in enumerate(texts):
                    before, encoded = tokens(trees[i]), 0
                    for (a, b, _), ps in zip(runs[i], cut[i]):
                        encoded += b - a
                        for j in range(a, b):
                            full = j - a < len(ps)
                            chars[i][j] = len(ps[j - a]) if full else 0
                            update(trees[i], j, next(counts) if full else 0)
                    rows.append((edited(text, edits[i]), chars[i], trees[i], before, tokens(trees[i]),
                                 len(edits[i]), encoded))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), _AFTER)]], names=_NAMES)

    _NAMES = ["id", "text", "leaf_chars", "tree", "tokens_before", "tokens_after", "n_edits", "leaves_encoded"]
    _AFTER = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 4
    fields = [trees.schema[n] for n in _NAMES[:4]] + [T.StructField(n, T.LongType()) for n in _NAMES[4:]]
    return trees.select("id", "text", "leaf_chars", "tree", F.col("edits").cast(EDIT)).mapInArrow(run, T.StructType(fields))


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, put in edits:
        out += [text[at:start], put]
        at = end
    return "".join(out) + text[at:]


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in groups of bounded size."""
    lo, size, out = 0, 0, []
    for i in range(len(column)):
        out.append(column[i].as_py() or "")
        size += len(out[-1])
        if size >= BATCH_CHARS:
            yield lo, out
            lo, size, out = i + 1, 0, []
    if out:
        yield lo, out
