"""op3: the ten nearest binary codes of every hundredth embedding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import hashing
from reelforge.llm.common import shared_folder

K, BITS = 10, 64


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded = rows.select(F.col("vec_id").alias("id"), hashing.code(F.col("embedding"), BITS).alias("code"))
    queries = coded.where(F.col("id") % 100 == 0)
    return hashing.nearest(coded, queries, K, shared_folder(spark, "op3"), BITS)


ORACLES = {"op3_exact_topk": f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
d AS (
  SELECT query_id, vec_id AS neighbour_id,
         CAST(list_sum(list_transform(range(1, {BITS + 1}),
              lambda i: CASE WHEN (a[i] > 0) <> (embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM q CROSS JOIN embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank
      FROM d)
SELECT * FROM r WHERE rank <= {K}"""}

QUERIES = {"op3_exact_topk": op3_exact_topk}
