"""op11: alignment of two tokenizers over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import alignment
from reelforge.llm.common import shared_folder


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, _ = alignment.aligned(docs, shared_folder(spark, "op11"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
                        "count_sum", "groups_sha256")


QUERIES = {"op11_cross_tokenizer": op11_cross_tokenizer}
