"""Session helpers.

The library never assumes it owns the session: callers (the driver, a
cluster job, a test) hand in a ``SparkSession``.  ``get_session`` is only a
convenience for tests, scripts and ``bench.py``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this package relies on for scale, not correctness.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what the planner has measured as small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "reelforge", extra: dict | None = None) -> SparkSession:
    """A session with this package's settings.  Without ``master`` the one of
    spark-submit holds; a plain Python process gets local cores."""
    b = (SparkSession.builder.appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:  # set by spark-submit
        b = b.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        b = b.config("spark.driver.memory", os.environ.get("REELFORGE_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that ``checkpoint()`` writes to: the one the caller or
    ``spark.checkpoint.dir`` has set.  Only a local session (tests) without
    one gets a private folder; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="reelforge-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """Whole-table read.  Parquet gives column pruning and filter pushdown."""
    return spark.read.parquet(table_path(sf_dir, name))
