"""op8: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import rules

BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rules.judged(docs, measures=BASE_MEASURES).select(
        "doc_id", *BASE_MEASURES, failed.alias("base_failed"), "kept")


_W = r"[^\x20\x09-\x0D]+"
ORACLES = {"op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
t AS (SELECT *, regexp_extract_all(text, '{_W}') AS w FROM d),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
win AS (
  SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
         lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS g,
         lead(word, 7) OVER o AS last_word, lag(word) OVER o AS prev, word
  FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win WHERE last_word IS NOT NULL) q
  WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) q GROUP BY r),
echo AS (SELECT r, count(*) AS n_echo FROM win WHERE word = prev GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '{_W}') GROUP BY r),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_echo, 0) AS n_echo, coalesce(n_lines, 0) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
         length(text) - length(replace(text, '!', '')) AS n_exclaims
  FROM t LEFT JOIN covered USING (r) LEFT JOIN echo USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 20 * n_symbols > word_chars OR 10 * n_upper > 6 * (n_upper + n_lower)
            OR 10 * n_exclaims > 3 * n_words OR 5 * n_echo > n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b"""}

QUERIES = {"op8_quality_rules": op8_quality_rules}
