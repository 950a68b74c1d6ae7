"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into S segments of 16 bits.  The index lists
every distinct code under each of its segment values.  A search probes, in
round r, the segment values at distance up to r from the query's.  A code
with a total distance of at most S * (r + 1) - 1 has a segment at distance r
or less, so the round finds all of them; it hands on those beyond the bound
of the round before, the others are known.  A query is finished as soon as k
rows are within the bound, and only unfinished queries go on.  The last round
(r = 16) covers every code.

Equal codes are one entry with its k smallest ids (more cannot be among the
k nearest), cut down before the shuffle, so a code that a third of all rows
share costs k ids; equal query codes are searched once.  A pair that several
probes find is kept only at its first segment within r, so it needs no
deduplication.

Defined results: a vector's bit is 1 where the component is above 0 (null
and NaN components give 0, a shorter vector's missing ones too); rows with a
null vector are not searched and find nothing; ties in distance are broken
by id; a query finds itself if it is a row; rows that repeat an id count
once; a null id is not searched; fewer than k rows give fewer neighbours; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.llm.common import stored

SEGMENT = 16


def code(vector: Column, bits: int) -> Column:
    """The signs of a vector as 16-bit segments."""
    def segment(s: int) -> Column:
        part = F.slice(vector, s * SEGMENT + 1, min(SEGMENT, bits - s * SEGMENT))
        value = F.aggregate(part, F.struct(F.lit(0).alias("v"), F.lit(1).alias("bit")), lambda a, x: F.struct(
            (a["v"] + F.when((x > 0) & ~F.isnan(x), a["bit"]).otherwise(0)).alias("v"), (a["bit"] * 2).alias("bit")))
        return value["v"]

    return F.array(*[segment(s) for s in range((bits + SEGMENT - 1) // SEGMENT)])


def distance(a: str, b: str, segments: int) -> Column:
    return sum((F.bit_count(F.get(F.col(a), F.lit(s)).bitwiseXOR(F.get(F.col(b), F.lit(s)))) for s in range(segments)),
               F.lit(0)).cast("int")


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of every code, cut before the shuffle."""
    first = Window.partitionBy("code").orderBy("id")
    return (rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k)
            .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))


def bound(r: int, segments: int) -> int:
    """All codes up to this distance are found by radius r."""
    return segments * (r + 1) - 1


def masks(r: int) -> list[int]:
    """The 16-bit values with at most r bits set."""
    return [m for m in range(1 << SEGMENT) if m.bit_count() <= r]


def round_pairs(active: DataFrame, postings: DataFrame, r: int, segments: int) -> DataFrame:
    """(query, code, ids, distance) of the codes between the bounds of round
    r - 1 and round r."""
    flips = F.split(F.lit(",".join(map(str, masks(r)))), ",").cast("array<int>")  # folded to one constant
    probes = (active.select("query", F.posexplode("query").alias("segment", "value"))
              .select("query", "segment", "value", F.explode(flips).alias("flip"))
              .select("query", "segment", F.col("value").bitwiseXOR(F.col("flip")).cast("int").alias("value")))
    # Each query makes many probes, which the planner does not foresee: never broadcast them.
    found = probes.join(postings.hint("merge"), ["segment", "value"])

    def apart(s: int) -> Column:
        return F.bit_count(F.get("query", F.lit(s)).bitwiseXOR(F.get("code", F.lit(s))))

    first = F.lit(True)
    for s in range(segments - 1):
        first = first & ((F.col("segment") <= s) | (apart(s) > r))
    far = distance("query", "code", segments)
    return (found.where((far > bound(r - 1, segments)) & (far <= bound(r, segments)) & first)
            .select("query", "code", "ids", far.alias("distance")))


def nearest(rows: DataFrame, queries: DataFrame, k: int, folder: str, bits: int = 64) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): the k rows nearest to every
    query.  ``rows`` and ``queries``: (id, code)."""
    segments = (bits + SEGMENT - 1) // SEGMENT
    entries = stored(smallest_ids(rows.where("id IS NOT NULL AND code IS NOT NULL").distinct(), k), folder, "entries")
    postings = entries.select("code", "ids", F.posexplode("code").alias("segment", "value"))
    asked = queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", F.col("code").alias("query")).distinct()
    active = stored(asked.select("query").distinct(), folder, "active-0")
    best, finished = None, None
    order = Window.partitionBy("query").orderBy("distance", "id")
    for r in range(SEGMENT + 1):
        if active.isEmpty():
            break
        new = round_pairs(active, postings, r, segments).select("query", F.explode("ids").alias("id"), "distance")
        pool = new if best is None else new.union(best)
        best = stored(pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"),
                      folder, f"best-{r}")
        done = (best.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query")
                if r < SEGMENT else active)
        out = best.join(done, "query", "left_semi")
        finished = out if finished is None else finished.union(out)
        active = stored(active.join(done, "query", "left_anti"), folder, f"active-{r + 1}")
        best = best.join(active, "query", "left_semi")
    if finished is None:
        finished = asked.select("query", "id", F.lit(0).alias("distance")).limit(0)
    return (asked.select(F.col("id").alias("query_id"), "query").join(finished, "query")
            .select("query_id", F.col("id").alias("neighbour_id"), "distance",
                    F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).alias("rank")))
