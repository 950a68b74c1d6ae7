"""op4: token counts of all documents before and after masking addresses."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import edits

# Possessive runs that begin where a run begins: linear in a text of one long word.
EMAIL = r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return edits.apply_edits(edits.build_trees(docs), mask=(EMAIL, "<email>")).select(
        F.col("id").alias("doc_id"), F.col("tokens_before").alias("n_tokens"), "n_edits",
        F.col("tokens_after").alias("n_tokens_edited"), F.size("leaf_chars").cast("long").alias("n_leaves"),
        "leaves_encoded")


QUERIES = {"op4_token_counts": op4_token_counts}
