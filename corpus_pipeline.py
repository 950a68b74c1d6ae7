"""From documents to packed training sequences: five stages, each one of the
operators in ``reelforge.llm``.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of the documents they got.  Nulls, empty and long texts, ties,
repeated rows, empty tables and other columns are handled as the operators
say; a document without words does not pass the quality rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelforge.llm import classifier, mixing, neardup, packing, rules
from reelforge.llm.common import in_file_order, shared_folder, stored
from reelforge.llm.q_classifier import training_rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    x = stored(classifier.vectors(docs), shared_folder(spark, "pipeline-classify"), "vectors")
    return classifier.good_documents(docs, classifier.train(training_rows(x, labels)))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.kept_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return neardup.one_of_each(docs, shared_folder(spark, "pipeline-dedup"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, in training order; a
    document is repeated as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece with its ids.  Tasks, so the
    upper bits of the sequence ids, follow the training order in which the mix
    was written; inside a task the packer's pool orders the pieces."""
    return packing.packed_documents(in_file_order(docs, ["doc_id", "text"]))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("minhash_near_dedup", deduplicate),
    ("source_mixing", mix),
    ("packing", pack),
]

#: Not expressible in SQL (a fitted model, near-duplicate groups, token ids).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"{i}-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
