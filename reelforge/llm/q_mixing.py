"""op1: mix all documents to target weights."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import mixing


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.curriculum(docs.select("doc_id", "text", "source"), keep=["doc_id"])
    first = F.round(F.get(F.col("_mx_turns.position"), F.lit(0)), 6)
    # Documents that are not taken have no position; their ids deal them out.
    order = [F.get(F.col("_mx_turns.position"), F.lit(0)), F.col("doc_id")]
    return (mixed.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("doc_id", F.col("_mx_size").alias("size"), F.col("_mx_words").alias("source_size"),
                    F.round("_mx_target", 6).alias("target"),
                    F.aggregate("_mx_turns.words", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
                    F.size("_mx_turns").alias("turns"), first.alias("first_position")))


_TIME = {
    0: "2 * 5 * y / (7.5 + sqrt(greatest(0, 56.25 - 10 * 5 * y)))",
    1: "2 * 2 * y / (2 + sqrt(4 + 0 * y))",
    2: "CASE WHEN y < 0.25 THEN 2 * y / (0.5 + sqrt(0.25)) "
       "ELSE 0.5 + 2 * (y - 0.25) / (0.5 + sqrt(0.25 + 8 * (y - 0.25))) END",
}

ORACLES = {"op1_mixing": f"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class,
         1.5 * sum(words) OVER () AS wish FROM src),
weighed AS (SELECT *, CAST(CASE class WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM ranked),
ratios AS (SELECT *, 2.0 * words / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (wish - coalesce(sum(2.0 * words) OVER (ORDER BY ratio, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM ratios),
chosen AS (SELECT lev FROM levels WHERE lev <= ratio ORDER BY ratio, lev LIMIT 1),
targets AS (
  SELECT source, words, class,
         CAST(least(2.0 * words, coalesce((SELECT lev FROM chosen) * weight, 2.0 * words)) AS DOUBLE) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.words, t.class, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(size, goal - begins)) AS one, greatest(0, least(size, goal - begins - words)) AS two,
         CASE WHEN target > 0 THEN begins / target ELSE 0 END AS y
  FROM placed)
SELECT doc_id, size, words AS source_size, round(target, 6) AS target, CAST(one + two AS BIGINT) AS taken,
       CAST((one > 0)::INT + (two > 0)::INT AS INTEGER) AS turns,
       CASE WHEN one > 0 THEN round(CASE class WHEN 0 THEN {_TIME[0]} WHEN 1 THEN {_TIME[1]} ELSE {_TIME[2]} END, 6)
       END AS first_position
FROM taken"""}

QUERIES = {"op1_mixing": op1_mixing}
