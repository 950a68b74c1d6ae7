"""op5: near-duplicate documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import neardup
from reelforge.llm.common import shared_folder


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = neardup.near_duplicates(docs, shared_folder(spark, "op5"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


QUERIES = {"op5_minhash_neardup": op5_minhash_neardup}
