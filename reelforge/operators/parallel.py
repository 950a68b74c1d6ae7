"""Parallelism of small, heavy inputs.

A table stored as one file with few row groups is read into fewer partitions
than the cluster has cores, which leaves cores idle when the work per row
dominates.  ``read_spread`` deals such a table out by a round-robin
repartition.  It looks at the planned splits of the bare scan (no job runs);
the rows are the same either way, and a large table has more splits than
cores and is read as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelforge.session import read_table


def default_parallelism(spark) -> int:
    """Cores of the cluster (classic sessions) or the shuffle-partition
    setting (sessions without a SparkContext, e.g. Spark Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read_spread(spark: SparkSession, sf_dir: str, name: str, columns: list[str], factor: int = 2) -> DataFrame:
    """The columns of a table, in at least as many partitions as there are cores."""
    cores = default_parallelism(spark)
    df = read_table(spark, sf_dir, name).select(*columns)
    try:
        n = df.rdd.getNumPartitions()  # splits of a scan: planned, not run
    except Exception:  # noqa: BLE001  no RDD API: leave the plan as it is
        return df
    return df.repartition(cores * factor) if n < cores else df
