"""File catalogs (S1-S3) and chunk-name parsing.

``file_catalog`` lists a directory tree with Spark's ``binaryFile`` source and
selects only ``path``: the ``content`` column is pruned, so no file body is
read.  ``catalog_from_paths`` gives the same (directory, filename) split for
any table of path strings, which is how a listing already stored in a table
(or the test tables) is catalogued.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: chunk file names written by the chunker.
CHUNK_NAME_PATTERN = r"vid_chunk__(\d*)__(\d*)\..{3}"


def file_catalog(spark: SparkSession, root: str, except_dir: Sequence[str] = (),
                 except_file: str = "") -> DataFrame:
    """S1-S3 on a real directory tree: (directory, filename) of every file."""
    paths = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(F.regexp_replace("path", r"^file:", "").alias("path")))
    root_clean = root.rstrip("/")
    cat = catalog_from_paths(paths, "path")
    rel = F.regexp_replace(F.col("directory"), "^" + _re_escape(root_clean) + "/?", "")
    return prune_catalog(cat.withColumn("_rel", rel), except_dir, except_file, rel_dir="_rel").drop("_rel")


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def catalog_from_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Split a path column into directory (all but the last segment) and filename."""
    p = F.col(path)
    return df.withColumns({
        "directory": F.regexp_extract(p, r"^(.*)/[^/]*$", 1),
        "filename": F.regexp_extract(p, r"([^/]*)$", 1),
    })


def prune_catalog(cat: DataFrame, except_dir: Sequence[str] = (), except_file: str = "",
                  rel_dir: str = "directory", filename: str = "filename") -> DataFrame:
    """S2 + S3: drop files under any directory named in ``except_dir`` (exact
    name, whole subtree) and files whose name matches ``except_file``
    (unanchored search).  An empty pattern excludes nothing."""
    out = cat
    if except_dir:
        parts = F.split(F.col(rel_dir), "/")
        out = out.filter(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in except_dir])))
    if except_file:
        out = out.filter(~F.col(filename).rlike(except_file))
    return out


def chunk_bounds(name: Column | str) -> tuple[Column, Column]:
    """Chunk file name -> (start, end) in ms."""
    c = F.col(name) if isinstance(name, str) else name
    return (F.regexp_extract(c, CHUNK_NAME_PATTERN, 1).try_cast("long"),
            F.regexp_extract(c, CHUNK_NAME_PATTERN, 2).try_cast("long"))
