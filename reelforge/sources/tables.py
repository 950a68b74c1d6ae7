"""CSV and table sources / sinks.

Writes are set-based (one job per batch of rows, never a row at a time) and
go to the path or table the caller names; nothing here uses a machine-local
scratch folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOM = "\ufeff"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True) -> DataFrame:
    """CSV with a header; a UTF-8 byte-order mark before the first header
    name is stripped.  With an explicit schema no inference pass is made."""
    r = spark.read.option("header", header).option("encoding", "UTF-8")
    df = r.schema(schema).csv(path) if schema is not None else r.csv(path)
    first = df.columns[0] if df.columns else None
    if first and first.startswith(BOM):
        df = df.withColumnRenamed(first, first[len(BOM):])
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", quote: str = '"', header: bool = True) -> None:
    """CSV sink without an index column; ``mode='append'`` appends,
    ``quote='|'`` gives the custom-quoted variant."""
    (df.write.mode(mode).option("header", header).option("quote", quote).option("escape", quote)
     .csv(path))


def feature_lines(df: DataFrame, name_col: str, vec_col: str) -> DataFrame:
    """``<basename>\\t<v1>\\t...\\t<vn>\\t`` with 6 decimals (the dump format)."""
    base = F.regexp_extract(F.regexp_replace(F.col(name_col), "/+$", ""), r"([^/]*)$", 1)
    vals = F.transform(F.col(vec_col), lambda x: F.format_string("%.6f", x.cast("double")))
    return df.select(F.concat(base, F.lit("\t"), F.array_join(vals, "\t"), F.lit("\t")).alias("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S7 sink: one text line per row."""
    lines.write.mode(mode).text(path)


def metric_table(stats: DataFrame, keys: Sequence[str], category_col: str, metrics: Sequence[str],
                 names: Sequence[str]) -> DataFrame:
    """Metric rows x category columns (3 metrics x 80 labels / 12 super
    categories), category names from the fixed list, one value per cell."""
    k = list(keys)
    long = stats.select(*k, F.col(category_col).alias("_cat"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_v")) for m in metrics])).alias("_m"))
    long = long.select(*k, "_cat", "_m.metric", "_m._v")
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("_cat") - 1)
    return long.withColumn("_name", name).groupBy(*k, "metric").pivot("_name", list(names)).agg(F.max("_v"))


def read_table(spark: SparkSession, path_or_table: str) -> DataFrame:
    """Whole-table read (parquet path or catalog table)."""
    if "/" in path_or_table:
        return spark.read.parquet(path_or_table)
    return spark.table(path_or_table)


def run_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """SQL text over named inputs, written as ``{name}`` in the text.
    They are bound for this text only; no view of the session is touched."""
    return spark.sql(sql, **views)


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Table sink, append or replace; a batch of rows is one
    set-based write (the single-row insert of the original becomes a batch)."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: StructType, location: str | None = None) -> bool:
    """Create a parquet table from a StructType if it does not exist;
    returns True when it was created."""
    if spark.catalog.tableExists(name):
        return False
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet{loc}")
    return True
