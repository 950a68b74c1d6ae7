"""op12: remove windows that also start in a document with a smaller id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import superkmers


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return superkmers.without_repeats(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_substring_dedup": op12_substring_dedup}

ORACLES = {"op12_substring_dedup": r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(words[i : i + 12], ' ') AS run FROM split, range(1, len(words) - 11) t(i)),
judged AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY run) AS again FROM windows),
places AS (
  SELECT s.r, p, words[p::INT] AS word,
         coalesce(max(CASE WHEN again THEN p END) OVER (PARTITION BY s.r ORDER BY p) > p - 13, false) AS gone
  FROM split s CROSS JOIN range(1, len(words) + 1) t(p) LEFT JOIN judged j ON j.r = s.r AND j.i = p)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM split s LEFT JOIN places USING (r) GROUP BY s.r, s.doc_id, s.words"""}
