"""op10: quality of all documents, learned from part of the labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import classifier
from reelforge.llm.common import fold, shared_folder, stored

FOLDS = 5


def training_rows(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y) of the labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("y"))
    return (vectors.where(fold(F.col("doc_id"), FOLDS) != 0).join(known, "doc_id").select("x", "y"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # One pass over the texts; learning and scoring read the small vectors.
    x = stored(classifier.vectors(docs), shared_folder(spark, "op10"), "vectors")
    model = classifier.train(training_rows(x, labels))
    return classifier.scored(x, model).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= classifier.THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
