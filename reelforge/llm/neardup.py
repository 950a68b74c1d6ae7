"""Near-duplicate documents by bottom-k sketches of one hash function.

1. One pass hashes the word shingles of every whole text and keeps, per
   document, the size of its set, a 128-bit key of the whole set and the k
   smallest hashes (the sketch).  Documents with equal sets are one class;
   everything below works on classes.
2. Inverted lists of retained values: two sets with Jaccard similarity J share
   about J * k of the k smallest hashes of their union, so at the threshold of
   0.75 a pair shares at least half of its sketch, except with a probability
   of a few in a million at the threshold itself and far less above it.  A class that shares fewer than that many values with any other class
   leaves; this is repeated on what is left.  Of the remaining values of a
   class only the rarest are listed (prefix filter): two classes that share t
   of them meet in one of the c - t + 1 rarest of either.
3. Linking without all pairs: every list links its members to one centre (the
   member whose values are the most common ones).  Candidate pairs are
   filtered by the estimate from the union sketch and confirmed on the full
   sets.  Connected components follow.
4. Pairs of one list that are still in different components: a second round
   with other centres, then all that remain, in blocks of bounded size, so
   that no link between different components is lost.

Defined results: a null or empty text, or one without words, has the empty
set and is linked with nothing; a text with fewer words than a shingle has
one shingle, the whole sequence; equal rows are one class; a null id is
carried, never a component's id unless no other is there (then null, and the
row is kept); an empty table gives an empty result; other columns are not
read.  Sets are compared as sets of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelforge.llm.common import blank, lower_ascii, span_hash, spans, stored, text_slices, window_hash
from reelforge.llm.components import components

SHINGLE, SKETCH, PERCENT = 5, 64, 75
#: A pair must share half of its sketch (see above).
LEAST_SHARE = 0.5
#: Lists of at most SHORT members are joined with themselves, longer ones are
#: compared in blocks, on the WIDE smallest hashes; at a similarity of 0.75 a
#: pair shares 0.7 of them but for less than one in a million.
SHORT, BLOCK, WIDE, WIDE_SHARE = 16, 256, 2048, 0.7


# --- shingles ---------------------------------------------------------------

def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column."""
    for lo, hi, data, at in text_slices(column):
        part = lower_ascii(data)
        starts, ends, rows = spans(~blank(part), at)
        words = span_hash(part, starts, ends)
        first, hashes = window_hash(words, rows, n)
        counts = np.bincount(rows, minlength=hi - lo)
        word_at = np.concatenate([[0], np.cumsum(counts)])
        shingle_at = np.searchsorted(first, word_at)
        for i in range(hi - lo):
            if counts[i] >= n:
                yield np.unique(hashes[shingle_at[i]:shingle_at[i + 1]])
            elif counts[i]:
                own = words[word_at[i]:word_at[i + 1]]
                yield window_hash(own, np.zeros(len(own), np.int64), len(own))[1]
            else:
                yield np.empty(0, np.uint64)


def _class_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, flat.view(np.int64))


def marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, node, sketch) of every document; no node without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sketch = [], [], []
            for h in shingle_sets(batch.column(1)):
                n.append(len(h))
                key.append(_class_key(h) if len(h) else None)
                sketch.append(h[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), _lists(sketch)],
                names=["id", "n_shingles", "node", "sketch"])

    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, T.StructType([
        T.StructField("id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()),
        T.StructField("sketch", T.ArrayType(T.LongType()))]))


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the wanted (node, rep) classes, from the text of rep."""
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(wanted.select("node", "rep"), F.col("id").eqNullSafe(F.col("rep"))).select("node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows of one id
        for batch in batches:
            keys, sets = [], []
            for key, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                if key not in seen and _class_key(h) == key:
                    seen.add(key)
                    keys.append(key)
                    sets.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists(sets)], names=["node", "hashes"])

    return rows.mapInArrow(run, "node binary, hashes array<long>")


# --- inverted lists -----------------------------------------------------------

def least_shared(size):
    """How many of its retained values a class must share with a partner."""
    return F.greatest(F.lit(1), F.floor(size * F.lit(LEAST_SHARE)))


def inverted_lists(classes: DataFrame, folder: str, passes: int = 2) -> DataFrame:
    """(value, node, centrality): the listed values of the classes that share
    enough of their sketch."""
    rows = classes.select("node", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    for i in range(passes):
        shared = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
        own = (rows.join(shared, "value").groupBy("node", "k")
               .agg(F.collect_list(F.struct("df", "value")).alias("own"))  # at most SKETCH values
               .where(F.size("own") >= least_shared(F.col("k"))))
        rows = stored(own.select("node", "k", F.explode("own").alias("v"))
                      .select("node", "k", "v.value", "v.df"), folder, f"values-{i}").drop("df") if i + 1 < passes else own
    prefix = F.size("own") - least_shared(F.col("k")) + 1
    central = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    return stored(rows.select("node", central.alias("centrality"),
                              F.explode(F.slice(F.array_sort("own"), F.lit(1), prefix)).alias("v"))
                  .select("v.value", "node", "centrality"), folder, "lists")


def star_pairs(lists: DataFrame, order) -> DataFrame:
    """Distinct (a, b): every list's centre, the largest by ``order``, with its members."""
    centre = lists.groupBy("value").agg(F.max(F.struct(order.alias("o"), "node")).alias("c")).select(
        "value", F.col("c.node").alias("a"))
    return lists.join(centre, "value").where("a <> node").select("a", F.col("node").alias("b"))


def unresolved(rest: DataFrame) -> DataFrame:
    """(value, node, root, lacks): the lists of ``rest`` (value, node, root)
    without comparisons that another list makes.

    Members that share an earlier value meet there.  If w is the most common
    of the values just before a list's own, only members that lack w have
    anything left to compare in this list: with all its members."""
    df = rest.groupBy("value").agg(F.count("*").alias("df"))
    own = (rest.join(df, "value").groupBy("node", "root")
           .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("own")))  # at most SKETCH values
    rows = (own.select("node", "root", "own", F.posexplode(F.col("own.value")).alias("at", "value"))
            .select("value", "node", "root", F.slice(F.col("own.value"), F.lit(1), F.col("at")).alias("before")))
    common = (rows.select("value", F.explode(F.slice(F.reverse("before"), 1, 4)).alias("w"))
              .groupBy("value", "w").agg(F.count("*").alias("n"))
              .groupBy("value").agg(F.max_by("w", F.struct("n", "w")).alias("w")))
    return (rows.join(common, "value", "left")
            .select("value", "node", "root", (~F.coalesce(F.array_contains("before", F.col("w")), F.lit(False))).alias("lacks")))


def block_pairs(rest: DataFrame, sketches: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """(a, b) that share a list, lie in different components and pass an
    estimate.  ``rest``: (value, node, root).

    Short lists are joined with themselves and use the sketches.  A longer
    list is cut into blocks of about BLOCK members; a task compares two
    blocks on the WIDE smallest hashes of the full sets.  For sets up to that
    size the comparison is exact, and one link for two components leaves the
    task; for larger sets all pairs that pass the estimate do."""
    rows = stored(unresolved(rest), folder, "unresolved")
    size = (rows.groupBy("value").agg(F.count("*").alias("m"), F.sum(F.col("lacks").cast("long")).alias("u"),
                                      F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("u > 0 AND lo <> hi").select("value", "m", "u"))
    rows = rows.join(size, "value")
    short, long = rows.where(F.col("m") <= SHORT), rows.where(F.col("m") > SHORT)
    one = short.where("lacks").select("value", F.col("node").alias("a"), F.col("root").alias("ra"))
    two = short.select("value", F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = (one.join(two, "value").where("ra <> rb")
              .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def blocks(n: str):
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def block(n: str):
        return F.pmod(F.xxhash64("node"), blocks(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), blocks(n) - 1))

    left = long.where("lacks").withColumn("x", block("u")).withColumn("y", every("m")).withColumn("side", F.lit(0))
    right = long.withColumn("y", block("m")).withColumn("x", every("u")).withColumn("side", F.lit(1))
    wide = sets.select("node", F.slice("hashes", 1, WIDE).alias("wide"), F.size("hashes").alias("n"))
    dealt = (left.select("value", "x", "y", "side", "node", "root")
             .union(right.select("value", "x", "y", "side", "node", "root")).join(wide, "node"))
    compared = dealt.groupBy("value", "x", "y").applyInArrow(_compare, "a binary, b binary")
    return likely(joined, sketches).union(
        compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Passing pairs of the rows of side 0 with those of side 1."""
    node, side, size = table["node"].to_pylist(), table["side"].to_numpy(), table["n"].to_numpy()
    root = np.unique(table["root"].to_pylist(), return_inverse=True)[1]
    lists = table["wide"].combine_chunks()
    flat, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    row, (value, at) = np.repeat(np.arange(len(node)), counts), np.unique(flat, return_inverse=True)
    common = np.bincount(at, minlength=len(value)) > 1
    slot, use = np.cumsum(common) - 1, common[at]
    has = np.zeros((len(node), int(common.sum())), np.float32)
    has[row[use], slot[at[use]]] = 1
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    shared = has[left] @ has[right].T
    most = np.maximum(counts[left][:, None], counts[right][None])
    total = size[left][:, None] + size[right][None]
    whole = (size[left][:, None] <= WIDE) & (size[right][None] <= WIDE)
    apart = root[left][:, None] != root[right][None]
    exact = whole & apart & (100 * shared >= PERCENT * (total - shared))
    p, q = np.nonzero(exact)
    # These are links already; one is enough to join two components.
    first = np.unique(np.column_stack([root[left[p]], root[right[q]]]), axis=0, return_index=True)[1]
    more = np.nonzero(~whole & apart & (shared >= WIDE_SHARE * most))
    p, q = np.concatenate([p[first], more[0]]), np.concatenate([q[first], more[1]])
    return pa.table({"a": pa.array([node[i] for i in left[p]], pa.binary()),
                     "b": pa.array([node[i] for i in right[q]], pa.binary())})


# --- candidate pairs to links ----------------------------------------------------

def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose similarity, estimated from the k smallest values of the
    union of both sketches, is not below LEAST_SHARE."""
    both = (pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b"))
    union = F.slice(F.array_sort(F.array_union(_unsigned("sa"), _unsigned("sb"))), 1, SKETCH)
    inside = F.array_intersect(union, F.array_intersect(_unsigned("sa"), _unsigned("sb")))
    return both.where(F.size(inside) >= least_shared(F.size(union))).select("a", "b")


def _unsigned(name: str):
    """Hashes ordered as unsigned numbers: the sign bit flipped."""
    return F.transform(F.col(name), lambda x: x.bitwiseXOR(F.lit(-1 << 63)))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    centre = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
            .join(centre.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a"))
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * common >= PERCENT * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def linked_classes(docs: DataFrame, folder: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, node) of every document and (node, root) of every
    class that is linked with another."""
    marked = stored(marks(docs, id_col, text_col), folder, "marks")
    classes = (marked.where("node IS NOT NULL").groupBy("node")
               .agg(F.min("id").alias("rep"), F.any_value("sketch").alias("sketch")))
    lists = inverted_lists(classes, folder)
    chosen = stored(classes.join(lists.select("node").distinct(), "node", "left_semi"), folder, "chosen")
    sketches, reps = chosen.select("node", "sketch"), chosen.select("node", "rep")

    def with_sets(nodes: DataFrame, sets: DataFrame | None, name: str) -> DataFrame:
        """The full sets, with those of more classes."""
        nodes = nodes.distinct()
        if sets is not None:
            nodes = nodes.join(sets.select("node"), "node", "left_anti")
        new = stored(full_sets(docs, reps.join(nodes, "node", "left_semi"), id_col, text_col), folder, f"{name}-sets")
        return new if sets is None else sets.union(new)

    def linked(pairs: DataFrame, sets: DataFrame | None, name: str) -> tuple[DataFrame, DataFrame]:
        """The confirmed pairs among likely ones, and the sets so far."""
        pairs = stored(pairs.distinct(), folder, f"{name}-pairs")
        sets = with_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), sets, name)
        return stored(confirmed(pairs, sets), folder, f"{name}-links"), sets

    def rooted(found: DataFrame) -> DataFrame:
        """The lists whose members are in different components."""
        rows = (lists.join(found, "node", "left")
                .select("value", "node", F.coalesce("root", "node").alias("root")))
        mixed = rows.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        return rows.join(mixed.select("value"), "value", "left_semi")

    links, sets = linked(likely(star_pairs(lists, F.col("centrality")).distinct(), sketches), None, "star")
    found = components(links, folder, "one")
    rest = stored(rooted(found), folder, "rest-1")
    if not rest.isEmpty():
        other = star_pairs(rest, F.xxhash64("value", "node"))
        roots = rest.select("node", "root").distinct()
        other = (other.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                 .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
                 .where("ra <> rb").select("a", "b").distinct())
        more, sets = linked(likely(other, sketches), sets, "other")
        links = links.union(more)
        found = components(links, folder, "two")
        rest = stored(rooted(found), folder, "rest-2")
        if not rest.isEmpty():
            sets = with_sets(rest.select("node"), sets, "rest")
            more, sets = linked(block_pairs(rest, sketches, sets, folder), sets, "block")
            found = components(links.union(more), folder, "three")
    return marked.select("id", "n_shingles", "node"), found


def _classes(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(node, rep, root): the smallest id and the component of every class."""
    return (marked.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"))
            .join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))


def near_duplicates(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component): one row per document; the component is
    the smallest id of all documents that links connect to it."""
    own, found = linked_classes(docs, folder, id_col, text_col)
    first = _classes(own, found)
    smallest = first.groupBy("root").agg(F.min("rep").alias("component"))
    named = first.join(smallest, "root").select("node", "component")
    return (own.join(named, "node", "left")
            .select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
                    .alias("component")))


def one_of_each(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates, with all their columns: of every
    component one document stays, that with the smallest id (null last; one
    row of it if rows repeat).  Documents without words all stay."""
    own, found = linked_classes(docs, folder, id_col, text_col)
    chosen = (_classes(own, found).groupBy("root")
              .agg(F.min_by("node", F.struct(F.col("rep").isNull(), "rep", "node")).alias("_nd_key"))
              .select("_nd_key", F.lit(True).alias("_nd_first")))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_class_key(h) if len(h) else None for h in shingle_sets(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())],
                                             names=[*batch.schema.names, "_nd_node"])

    keyed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_nd_node", T.BinaryType())]))
    # A document without words is a class of its own.  Copies go before the shuffle.
    alone = F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")
    first = Window.partitionBy("_nd_key").orderBy(F.col(id_col).asc_nulls_last())
    return (keyed.withColumn("_nd_key", F.coalesce("_nd_node", alone))
            .withColumn("_nd_at", F.row_number().over(first)).where("_nd_at = 1")
            .join(chosen, "_nd_key", "left").where("_nd_first OR _nd_node IS NULL").select(*docs.columns))
