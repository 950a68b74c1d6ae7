"""op9: licenses named in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import licenses
from reelforge.llm.common import shared_folder


def _joined(labels):
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = licenses.scan(docs, shared_folder(spark, "op9"))
    base, starts = F.col("places.label"), F.col("places.at")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined(base).alias("base_labels"), _joined(F.concat(base, F.col("matched"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.round("containment", 6)).alias("score"))


def _oracle() -> str:
    values = ", ".join(str(r) for r in licenses.template_rows())
    phrases = " UNION ALL ".join(
        f"SELECT r, i - 1 AS pos, '{label}' AS label FROM nb WHERE " + " AND ".join(
            f"w{j} = '{w}'" for j, w in enumerate(text.split())) for text, label in licenses.PHRASES)
    return rf"""
WITH t(template, label, token, size, need, stride, counts, must, never, musts) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{licenses.WORD}') AS w FROM documents),
word AS (SELECT r, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM d),
nb AS (SELECT r, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM word
       WINDOW o AS (PARTITION BY r ORDER BY i)),
place AS ({phrases}),
pair AS (SELECT r, i - 1 AS pos, w0 || ' ' || w1 AS token FROM nb WHERE w1 IS NOT NULL),
own AS (SELECT r, pos // stride AS block, t.* FROM pair JOIN t USING (token)
        UNION SELECT r, pos // stride - 1, t.* FROM pair JOIN t USING (token) WHERE pos >= stride),
hit AS (
  SELECT r, block, template, label, size, sum(counts) AS n FROM own
  GROUP BY r, block, template, label, size, need, musts
  HAVING sum(counts) >= need AND sum(must) = musts AND sum(never) = 0),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM place GROUP BY r),
best AS (SELECT r, max(n / size) AS containment FROM hit GROUP BY r),
both_labels AS (SELECT DISTINCT r, label FROM (SELECT r, label FROM hit UNION ALL SELECT r, label FROM place) q),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM both_labels GROUP BY r),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels
       FROM (SELECT DISTINCT r, label FROM place) q GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(containment, 0), 6) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN bl USING (r) LEFT JOIN l USING (r) LEFT JOIN best USING (r)"""


ORACLES = {"op9_license_scan": _oracle()}
QUERIES = {"op9_license_scan": op9_license_scan}
