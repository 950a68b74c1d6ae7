"""op13: damage all conversations and repair them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import repair
from reelforge.llm.common import shared_folder

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def damaged(rows: DataFrame) -> DataFrame:
    """One row in twenty each is dropped (``present`` false), emptied, loses
    its sentence ends, is repeated, or is made a user's; nulls are one space."""
    def key(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn"))) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(
        "conv_id", "turn", (kind != 0).alias("present"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    decided, turns = repair.repaired(damaged(rows), shared_folder(spark, "op13"), present=F.col("present"))
    own = repair.digests(turns).select(F.col("conv").alias("c"), "sha256")
    return (decided.join(own, F.col("conv").eqNullSafe(F.col("c")), "left")
            .select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    F.coalesce("sha256", F.lit(EMPTY)).alias("repaired_sha256")))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

# The path in SQL compares (cost, audit) of whole completions, row by row from the end.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _ins(s: str) -> str:
    """Completion s after one inserted turn."""
    return f"{{'c': {s}.c + 3, 'a': 'I' || {s}.a}}"


def _inserts(x: str) -> str:
    """Best completions with up to two inserted turns, from x0, xs, xu, xa."""
    def two(own, then, after):
        one = f"least({x}{then}, {_ins(x + after)})"
        return f"least({x}{own}, {_ins(one)})"

    return ", ".join(f"{two(o, t, a)} AS {o}" for o, t, a in (("o", "u", "a"), ("s", "u", "a"), ("u", "a", "u"),
                                                              ("a", "u", "a")))


def _row(state: str, fits: list[tuple[str, str]], then: str) -> str:
    keep = " ".join(f"WHEN initial = '{i}' THEN {{'c': b.{t}.c + extra, 'a': 'K' || b.{t}.a}}" for i, t in fits)
    dele = f"{{'c': b.{state}.c + 4, 'a': 'D' || b.{state}.a}}"
    rest = f"{{'c': b.{then}.c + 3 + extra, 'a': 'R' || b.{then}.a}}"
    return (f"CASE WHEN gone THEN {dele} ELSE least({dele}, {rest}, CASE {keep} ELSE {dele} END) END AS x{state}")


ORACLES = {"op13_conversation_repair": f"""
WITH RECURSIVE byte_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS t FROM (SELECT range AS i FROM range(256))),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j::INT, 1))::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations), byte_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         rtrim(text, {_BLANKS}) AS body, left(role, 1) AS initial FROM hurt),
faulty AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN body = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
steps AS (SELECT conv_id, i, initial, fault IN ('blank', 'duplicate') AS gone,
                 CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty),
figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
back AS (
  SELECT conv_id, n AS i, {_inserts('x')} FROM (
    SELECT conv_id, n, {{'c': 0, 'a': ''}} AS xo, {{'c': 1000000000, 'a': ''}} AS xs, {{'c': 1000000000, 'a': ''}} AS xu,
           {{'c': 0, 'a': ''}} AS xa FROM figures)
  UNION ALL
  SELECT conv_id, i - 1, {_inserts('x')} FROM (
    SELECT b.conv_id, b.i, {_row('o', [('s', 's'), ('u', 'u')], 'u')}, {_row('s', [('u', 'u')], 'u')},
           {_row('u', [('a', 'a')], 'a')}, {_row('a', [('u', 'u')], 'u')}
    FROM back b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i WHERE b.i > 0)),
audits AS (SELECT conv_id, o.c AS cost, o.a AS audit FROM back WHERE i = 0),
letters AS (
  SELECT conv_id, p, substr(audit, p::INT, 1) AS edit,
         length(replace(substr(audit, 1, p::INT), 'I', '')) AS i FROM audits, range(1, length(audit) + 1) r(p)),
said AS (
  SELECT l.*, CASE WHEN edit = 'K' THEN role END AS own, CASE WHEN edit IN ('I') THEN '' ELSE text END AS body
  FROM letters l LEFT JOIN placed f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND edit <> 'I'
  WHERE edit <> 'D'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p)
           - CASE WHEN first_value(left(own, 1)) OVER (PARTITION BY conv_id ORDER BY p) = 's' THEN 1 ELSE 0 END AS q FROM said),
whole AS (
  SELECT conv_id, sha256(string_agg(coalesce(own, CASE WHEN q % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || body,
                                    chr(10) ORDER BY p)) AS sha FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""}
