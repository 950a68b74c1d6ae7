"""Connected components of a link table by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.llm.common import stored


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): nodes share a root if
    and only if links connect them.

    Each round points every node at the smallest node among itself and its
    neighbours, follows these pointers once more, and contracts the links to
    the ones between different roots; a component of n nodes needs about
    log n rounds.  Every round is a stored table, so a lost executor repeats
    one round at most.  Null and self links are ignored.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct(), folder, f"{name}-edges-0")
    found = None
    n = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("up"))
        # Follow the pointer twice: node -> up -> up of up.
        two = (up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
               .select("node", F.coalesce("top", "up").alias("up")))
        step = stored(two, folder, f"{name}-step-{n}")
        found = step if found is None else stored(
            found.withColumnRenamed("up", "at").join(
                step.select(F.col("node").alias("at"), "up"), "at", "left")
            .select("node", F.coalesce("up", "at").alias("up")), folder, f"{name}-found-{n}")
        left = step.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = step.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        n += 1
        edges = stored(edges.join(left, "a").join(right, "b").where("ua <> ub")
                       .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(),
                       folder, f"{name}-edges-{n}")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.select("node", F.col("up").alias("root"))
