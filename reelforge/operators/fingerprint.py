"""Landmark-pair fingerprinting re-aimed as relational alignment.

Any ordered sequence of symbols (audio peaks, words) is fingerprinted by
pairing each symbol with the next ``fan_out`` symbols; a pair is the key
``a <sep> b <sep> distance`` and its 64-bit ``xxhash64``.  Pairs are built
inside each row with higher-order array functions, so indexing needs no
shuffle.  Recognition is an equi-join on (hash, key) (the key check makes
hash collisions harmless), a partial aggregate of votes per (query chunk,
item, offset difference) and a best-per-chunk pick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6

from reelforge.functions.text import tokens

SEP = "\u0001"


def landmarks(df: DataFrame, id_col: str, text_col: str, fan_out: int = 2, chunk: int | None = None,
              with_key: bool = True) -> DataFrame:
    """(id, pos, d, a, b, hash[, key]) for every symbol pair (a, b) within
    ``fan_out`` positions (and within the same ``chunk`` when given).

    Pairs come from zipping the token array with its shifted slices and one
    ``posexplode`` (built-in functions only, no per-element lambdas); the
    hash is taken over (a, b, d) directly and the printable ``key`` is
    optional."""
    t = df.select(id_col, tokens(text_col).alias("_t"))
    n = F.size("_t")
    shifted = [F.slice("_t", F.lit(d + 1), F.greatest(n - d, F.lit(1))) for d in range(1, fan_out + 1)]
    z = F.arrays_zip(F.col("_t").alias("a"), *[c.alias(f"b{d}") for d, c in zip(range(1, fan_out + 1), shifted)])
    rows = t.select(id_col, F.posexplode(z).alias("pos", "_z"))
    pairs = rows.select(id_col, F.col("pos").cast("long").alias("pos"), F.col("_z.a").alias("a"),
                        F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_z.b{d}").alias("b"))
                                            for d in range(1, fan_out + 1)])).alias("_p"))
    out = pairs.select(id_col, "pos", "_p.d", "a", "_p.b").filter(F.col("b").isNotNull())
    if chunk:
        out = out.filter(F.floor(F.col("pos") / chunk) == F.floor((F.col("pos") + F.col("d")) / chunk))
    out = out.withColumn("hash", F.xxhash64("a", "b", "d"))
    if with_key:
        out = out.withColumn("key", F.concat_ws(SEP, "a", "b", F.col("d").cast("string")))
    return out


def build_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text", fan_out: int = 2) -> DataFrame:
    """Fingerprint index of a directory of items."""
    return landmarks(items, id_col, text_col, fan_out).withColumnRenamed(id_col, "item_id")


def index_new_items(items: DataFrame, existing_index: DataFrame, id_col: str = "item_id", text_col: str = "text",
                    fan_out: int = 2) -> DataFrame:
    """Index only items not indexed yet (anti-join on the item id)."""
    done = existing_index.select(F.col("item_id").alias(id_col)).distinct()
    return build_index(items.join(done, id_col, "left_anti"), id_col, text_col, fan_out)


def recognise(queries: DataFrame, index: DataFrame, query_id: str, text_col: str, chunk: int = 64,
              fan_out: int = 2, min_confidence: float = 0.01, salts: int = 8) -> DataFrame:
    """R2 + F5: split every query text into ``chunk``-symbol chunks, vote on
    (item, offset difference) through shared landmark pairs and keep the
    best item per chunk (most votes, then lowest item id, then lowest
    offset).  confidence = votes / query pairs of the chunk; chunks without
    a result or under ``min_confidence`` keep an all-null match.

    One pass over the texts: every chunk gives its pairs (a chunk without
    pairs gives one empty row), which meet the index in a left join, so no
    second scan finds the chunks.  Index rows of one pair are dealt over
    ``salts`` cells by item and the pairs are copied to the cells their index
    rows use, so a pair that very many items share is joined in parts."""
    n = F.size("_t")
    own = F.slice("_t", F.col("chunk").cast("int") * chunk + 1, F.lit(chunk))
    chunks = (queries.select(query_id, tokens(text_col).alias("_t")).where(n > 0)
              .select(query_id, "_t", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("chunk"))
              .select(query_id, "chunk", own.alias("_c")))
    m = F.size("_c")
    shifted = [F.slice("_c", F.lit(d + 1), F.greatest(m - d, F.lit(1))) for d in range(1, fan_out + 1)]
    z = F.arrays_zip(F.col("_c").alias("a"), *[c.alias(f"b{d}") for d, c in enumerate(shifted, 1)])
    inside = F.flatten(F.transform(z, lambda x, i: F.filter(F.array(*[
        F.struct(i.cast("long").alias("i"), x["a"].alias("a"), x[f"b{d}"].alias("b"), F.lit(d).alias("d"))
        for d in range(1, fan_out + 1)]), lambda p: p["b"].isNotNull())))
    n_pairs = sum(F.greatest(m - d, F.lit(0)) for d in range(1, fan_out + 1)).cast("long")
    q = (chunks.select(query_id, F.col("chunk").cast("long").alias("chunk"), n_pairs.alias("n_hashes"),
                       F.explode_outer(inside).alias("_p"))
         .select(query_id, "chunk", "n_hashes", (F.col("chunk") * chunk + F.col("_p.i")).alias("pos"),
                 F.xxhash64("_p.a", "_p.b", "_p.d").alias("hash"), F.col("_p.a").alias("a"), F.col("_p.b").alias("b"),
                 F.col("_p.d").alias("d")))
    idx = index.select("hash", F.col("a").alias("_ia"), F.col("b").alias("_ib"), F.col("d").alias("_id"), "item_id",
                       F.col("pos").alias("item_pos"), F.pmod(F.xxhash64("item_id"), F.lit(salts)).alias("_salt"))
    cells = idx.groupBy("hash").agg(F.collect_set("_salt").alias("_cells"))  # at most ``salts`` numbers
    q = (q.join(cells, "hash", "left")
         .withColumn("_salt", F.explode_outer("_cells")).drop("_cells"))
    # Equal hashes are followed by an exact check of the pair.
    votes = (q.join(idx, ["hash", "_salt"], "left")
             .select(query_id, "chunk", "n_hashes", F.when(
                 (F.col("a") == F.col("_ia")) & (F.col("b") == F.col("_ib")) & (F.col("d") == F.col("_id")),
                 F.struct("item_id", (F.col("pos") - F.col("item_pos")).alias("offset"))).alias("_v"))
             .groupBy(query_id, "chunk", "n_hashes", "_v").agg(F.count("_v").alias("votes")))
    best = votes.groupBy(query_id, "chunk", "n_hashes").agg(F.min_by(
        F.struct("_v", "votes"), F.struct(-F.col("votes"), "_v")).alias("_r"))
    conf = F.try_divide(F.col("_r.votes"), F.col("n_hashes"))
    ok = F.coalesce((conf >= min_confidence) & (F.col("_r.votes") > 0), F.lit(False))
    return best.select(query_id, "chunk", F.when(ok, F.col("_r._v.item_id")).alias("item_id"),
                       F.when(ok, r6(conf)).alias("input_confidence"), F.when(ok, F.col("_r._v.offset")).alias("offset"),
                       F.when(ok, F.col("_r.votes")).alias("votes"))
