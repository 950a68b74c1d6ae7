"""op2: language-model scores of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import ppm
from reelforge.llm.common import fold, shared_folder

FOLDS, HELD_OUT = 5, 1


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = ppm.pretrained_scores(docs, fold(F.col("doc_id"), FOLDS) != HELD_OUT, shared_folder(spark, "op2"))
    return scores.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
