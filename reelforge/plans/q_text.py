"""Queries for sources S1-S3, S14 and the text / name family T1-T14."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import text as T
from reelforge.operators.parallel import read_spread
from reelforge.plans.adapters import (CHUNKS_SQL, PART_FILES_SQL, PATH_SPLIT_SQL, PATHS_SQL, chunks, part_files,
                                      paths, with_ctes)
from reelforge.plans.registry import register
from reelforge.session import read_table
from reelforge.sources import files as S

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.FILENAME_STOPWORDS) + "]"


def _tokens_sql(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: w <> '')"


def _rm_stop_sql(x: str) -> str:
    return f"array_to_string(list_filter({_tokens_sql(x)}, lambda w: NOT list_contains({STOP_SQL}, w)), ' ')"


def _clean_sql(x: str, allow_numbers: bool = True) -> str:
    special = "[^A-Za-z0-9]+" if allow_numbers else "[^A-Za-z]+"
    s = f"regexp_replace({x}, '{special}', ' ', 'g')"
    s = f"regexp_replace({s}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"regexp_replace({_rm_stop_sql(f'lower({s})')}, '\\s\\s+', ' ', 'g')"


# ---- S1-S3 ------------------------------------------------------------------------
@register("s01_file_catalog", with_ctes("SELECT page_id, directory, filename FROM split", paths=PATHS_SQL,
                                        split=PATH_SPLIT_SQL))
def s01_file_catalog(spark, sf):
    return S.catalog_from_paths(paths(spark, sf), "path").select("page_id", "directory", "filename")


EXCEPT_DIRS = ["fr", "de"]
EXCEPT_FILE = r"\.html|^8"


@register("s02_prune_dirs", with_ctes(
    "SELECT page_id, directory, filename FROM split WHERE NOT list_has_any(string_split(directory, '/'), "
    + "[" + ", ".join(f"'{d}'" for d in EXCEPT_DIRS) + "])", paths=PATHS_SQL, split=PATH_SPLIT_SQL))
def s02_prune_dirs(spark, sf):
    cat = S.catalog_from_paths(paths(spark, sf), "path")
    return S.prune_catalog(cat, except_dir=EXCEPT_DIRS).select("page_id", "directory", "filename")


@register("s03_exclude_files", with_ctes(
    f"SELECT page_id, directory, filename FROM split WHERE NOT regexp_matches(filename, '{EXCEPT_FILE}')",
    paths=PATHS_SQL, split=PATH_SPLIT_SQL))
def s03_exclude_files(spark, sf):
    cat = S.catalog_from_paths(paths(spark, sf), "path")
    return S.prune_catalog(cat, except_file=EXCEPT_FILE).select("page_id", "directory", "filename")


# ---- S14 --------------------------------------------------------------------------
@register("s14_chunk_name_bounds", with_ctes("""
SELECT video_id, name,
       TRY_CAST(regexp_extract(name, 'vid_chunk__(\\d*)__(\\d*)\\..{3}', 1) AS BIGINT) AS start,
       TRY_CAST(regexp_extract(name, 'vid_chunk__(\\d*)__(\\d*)\\..{3}', 2) AS BIGINT) AS "end"
FROM (SELECT video_id, 'vid_chunk__' || start || '__' || "end" || '.wav' AS name FROM chunks)""", chunks=CHUNKS_SQL))
def s14_chunk_name_bounds(spark, sf):
    named = chunks(spark, sf).select(
        "video_id", F.concat(F.lit("vid_chunk__"), "start", F.lit("__"), "end", F.lit(".wav")).alias("name"))
    s, e = S.chunk_bounds("name")
    return named.select("video_id", "name", s.alias("start"), e.alias("end"))


# ---- T1 ---------------------------------------------------------------------------
def _t01_sql(modality: str, allow_numbers: bool) -> str:
    pat = T.SUFFIX_PATTERNS[modality]
    return with_ctes(f"""
SELECT p_partkey, filename, title, file_type FROM (
  SELECT p_partkey, filename, {_clean_sql(f"regexp_extract(filename, '{pat}', 1)", allow_numbers)} AS title,
         regexp_replace(regexp_extract(filename, '{pat}', 2), '^\\.+|\\.+$', '', 'g') AS file_type
  FROM files) WHERE title <> ''""", files=PART_FILES_SQL)


def _t01(modality, allow_numbers):
    def q(spark, sf):
        return T.cleanup_file_titles(part_files(spark, sf), modality, allow_numbers).select(
            "p_partkey", "filename", "title", "file_type")
    return q


register("t01_file_titles_midi", _t01_sql("midi", True))(_t01("midi", True))
register("t01_file_titles_audio", _t01_sql("audio", False))(_t01("audio", False))
register("t01_file_titles_video", _t01_sql("video", True))(_t01("video", True))


# ---- T3-T7 on documents --------------------------------------------------------------
@register("t03_replace_special", """
SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g') AS alnum,
       regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS alpha FROM documents""")
def t03_replace_special(spark, sf):
    d = read_spread(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", T.replace_special("text", True).alias("alnum"),
                    T.replace_special("text", False).alias("alpha"))


@register("t04_clean_part_names", f"""
SELECT p_partkey, {_clean_sql("p_name || ' ' || p_brand || p_type", True)} AS title_num,
       {_clean_sql("p_name || ' ' || p_brand || p_type", False)} AS title_alpha FROM part""")
def t04_clean_part_names(spark, sf):
    p = read_table(spark, sf, "part")
    raw = F.concat("p_name", F.lit(" "), "p_brand", "p_type")
    return p.select("p_partkey", T.clean_title(raw, True).alias("title_num"),
                    T.clean_title(raw, False).alias("title_alpha"))


@register("t04_clean_customer_names", f"""
SELECT c_custkey, {_clean_sql("c_name || c_mktsegment", True)} AS title_num,
       {_clean_sql("c_name || c_mktsegment", False)} AS title_alpha FROM customer""")
def t04_clean_customer_names(spark, sf):
    c = read_table(spark, sf, "customer")
    raw = F.concat("c_name", "c_mktsegment")
    return c.select("c_custkey", T.clean_title(raw, True).alias("title_num"),
                    T.clean_title(raw, False).alias("title_alpha"))


@register("t04_clean_document_text", f"""
SELECT doc_id, {_clean_sql("text", True)} AS clean_text FROM documents""")
def t04_clean_document_text(spark, sf):
    d = read_spread(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", T.clean_title("text", True).alias("clean_text"))


@register("t05_remove_stopwords", f"SELECT doc_id, {_rm_stop_sql('text')} AS text FROM documents")
def t05_remove_stopwords(spark, sf):
    return read_spread(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", T.remove_stopwords("text").alias("text"))


@register("t06_collapse_spaces", "SELECT doc_id, regexp_replace(text, '\\s\\s+', ' ', 'g') AS text FROM documents")
def t06_collapse_spaces(spark, sf):
    return read_spread(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", T.collapse_spaces("text").alias("text"))


T07_N = 25


@register("t07_stopword_candidates", f"""
SELECT token, count(*) AS freq FROM (SELECT unnest({_tokens_sql('text')}) AS token FROM documents)
WHERE length(token) < 4 GROUP BY token ORDER BY freq DESC, token LIMIT {T07_N}""")
def t07_stopword_candidates(spark, sf):
    return T.stopword_candidates(read_spread(spark, sf, "documents", ["doc_id", "text"]), "text", n=T07_N)


# ---- T8-T14 ---------------------------------------------------------------------------
@register("t08_pair_ids", """
SELECT l_orderkey, l_linenumber, 'M' || l_suppkey || 'A' || l_partkey AS midi_audio_pair,
       'V' || l_orderkey || 'A' || l_partkey AS video_audio_pair FROM lineitem""")
def t08_pair_ids(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", T.pair_id("M", "l_suppkey", "A", "l_partkey").alias("midi_audio_pair"),
                     T.pair_id("V", "l_orderkey", "A", "l_partkey").alias("video_audio_pair"))


@register("t09_new_file_name", with_ctes("""
SELECT p_partkey, ('M' || p_partkey || 'A' || p_partkey) || '_' || filename AS new_name FROM files""",
                                         files=PART_FILES_SQL))
def t09_new_file_name(spark, sf):
    f = part_files(spark, sf)
    return f.select("p_partkey", T.new_file_name(T.pair_id("M", "p_partkey", "A", "p_partkey"), "filename")
                    .alias("new_name"))


@register("t10_clip_name", """
SELECT o_orderkey, 'V' || o_orderkey || '_' || (o_custkey * 5000) || '.' || 'mp4' AS target_name FROM orders""")
def t10_clip_name(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", T.clip_name("o_orderkey", F.col("o_custkey") * 5000, F.lit("mp4"))
                    .alias("target_name"))


@register("t11_cropped_target_name", """
SELECT o_orderkey, '/clips/' || left(o_orderpriority, greatest(length(o_orderpriority) - 4, 0)) || '__'
       || o_custkey || '.mp4' AS target_name FROM orders""")
def t11_cropped_target_name(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", T.cropped_target_name(F.lit("/clips/"), "o_orderpriority", "o_custkey",
                                                        F.lit(".mp4")).alias("target_name"))


@register("t12_path_join", with_ctes("SELECT page_id, directory || '/' || filename AS full_path FROM split",
                                     paths=PATHS_SQL, split=PATH_SPLIT_SQL))
def t12_path_join(spark, sf):
    cat = S.catalog_from_paths(paths(spark, sf), "path")
    return cat.select("page_id", T.path_join("directory", "filename").alias("full_path"))


@register("t13_type_suffix", with_ctes("SELECT page_id, right(path, 3) AS file_type FROM paths", paths=PATHS_SQL))
def t13_type_suffix(spark, sf):
    return paths(spark, sf).select("page_id", T.type_suffix("path").alias("file_type"))


_T14_X = "CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '_') ELSE c_name END"


@register("t14_prefix_before_underscore", f"""
SELECT c_custkey, CASE WHEN strpos({_T14_X}, '_') = 0 THEN '' ELSE left({_T14_X}, strpos({_T14_X}, '_') - 1) END
       AS prefix FROM customer""")
def t14_prefix_before_underscore(spark, sf):
    c = read_table(spark, sf, "customer")
    x = F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", T.prefix_before(x).alias("prefix"))
