"""Queries for catalog matching, set operations and the training table
(J1-J13, O1-O6, A1, F6, F7, Q1-Q8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.functions import text as T
from reelforge.operators import matching as M
from reelforge.operators import training as TR
from reelforge.plans.adapters import (CHUNKS_SQL, PART_FILES_SQL, STAR_SQL, chunks, part_files, star, with_ctes)
from reelforge.operators.parallel import read_spread
from reelforge.plans.q_text import _clean_sql
from reelforge.plans.registry import register
from reelforge.session import read_table


def _star_sql(body: str, *names: str) -> str:
    order = list(STAR_SQL)
    need = set(names)
    if "songs" in need:
        need.add("mam")
    return with_ctes(body, **{n: STAR_SQL[n] for n in order if n in need})


# ---- two catalogs from part: even keys = midi, odd keys = audio, key = p_name ----
def _catalogs(spark, sf):
    p = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    cat = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("directory"),
                   F.col("p_name").alias("spotify_URL"))
    return (cat.filter(F.col("id") % 2 == 0).withColumn("filename", F.concat(F.col("spotify_URL"), F.lit(".mid"))),
            cat.filter(F.col("id") % 2 == 1).withColumn("filename", F.concat(F.col("spotify_URL"), F.lit(".mp3"))))


_CATS_SQL = dict(
    midi="SELECT p_partkey AS id, p_brand AS directory, p_name AS spotify_URL, p_name || '.mid' AS filename "
         "FROM part WHERE p_partkey % 2 = 0",
    audio="SELECT p_partkey AS id, p_brand AS directory, p_name AS spotify_URL, p_name || '.mp3' AS filename "
          "FROM part WHERE p_partkey % 2 = 1")


@register("j05_catalog_match", with_ctes("""
SELECT m.spotify_URL, count(DISTINCT m.id) AS n_midi, count(DISTINCT a.id) AS n_audio, count(*) AS n_pairs,
       min(m.id) AS first_midi, min(a.id) AS first_audio
FROM midi m JOIN audio a USING (spotify_URL) GROUP BY m.spotify_URL""", **_CATS_SQL))
def j05_catalog_match(spark, sf):
    midi, audio = _catalogs(spark, sf)
    return M.count_matches(midi, audio, "spotify_URL", names=("midi", "audio"))


@register("j06_catalog_match_first", with_ctes("""
SELECT spotify_URL, id_midi, id_audio, 'M' || id_midi || 'A' || id_audio AS pair_id,
       'M' || id_midi || 'A' || id_audio || '_' || filename_midi AS new_midi_name FROM (
  SELECT m.spotify_URL, m.id AS id_midi, a.id AS id_audio, m.filename AS filename_midi,
         row_number() OVER (PARTITION BY m.spotify_URL ORDER BY m.id, a.id) AS rn
  FROM midi m JOIN audio a USING (spotify_URL)) WHERE rn = 1""", **_CATS_SQL))
def j06_catalog_match_first(spark, sf):
    midi, audio = _catalogs(spark, sf)
    m = M.match_catalogs(midi, audio, "spotify_URL")
    pid = T.pair_id("M", "id_midi", "A", "id_audio")
    return m.select("spotify_URL", "id_midi", "id_audio", pid.alias("pair_id"),
                    T.new_file_name(pid, "filename_midi").alias("new_midi_name"))


# ---- J1: title enrichment -----------------------------------------------------------
def _refs(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(F.col("p_name").alias("clean_title"), F.col("p_partkey").alias("song_id"),
                    F.col("p_brand").alias("spotify_artist"),
                    F.concat(F.lit("https://open.example/track/"), F.col("p_partkey").cast("string")).alias("spotify_URL"))


_REFS_SQL = """SELECT clean_title, song_id, spotify_artist, spotify_URL FROM (
  SELECT p_name AS clean_title, p_partkey AS song_id, p_brand AS spotify_artist,
         'https://open.example/track/' || p_partkey AS spotify_URL,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1"""
_TITLES_SQL = f"""SELECT p_partkey, filename, title FROM (
  SELECT p_partkey, filename, {_clean_sql("regexp_extract(filename, '" + T.SUFFIX_PATTERNS['midi'] + "', 1)", True)} AS title
  FROM files) WHERE title <> ''"""


@register("j01_title_enrichment", with_ctes("""
SELECT t.p_partkey, t.title, r.song_id, r.spotify_artist, r.spotify_URL FROM titles t LEFT JOIN refs r
ON t.title = r.clean_title""", files=PART_FILES_SQL, titles=_TITLES_SQL, refs=_REFS_SQL))
def j01_title_enrichment(spark, sf):
    cat = T.cleanup_file_titles(part_files(spark, sf), "midi", True)
    return M.enrich_titles(cat, _refs(spark, sf)).select("p_partkey", "title", "song_id", "spotify_artist",
                                                         "spotify_URL")


@register("a01_match_rate", with_ctes("""
SELECT count(r.song_id) AS matched, count(*) AS total, floor((100.0 * count(r.song_id) / count(*)) * 1e6 + 0.5) / 1e6 AS rate,
       CAST(floor(100.0 * count(r.song_id) / count(*)) AS BIGINT) AS rate_int
FROM titles t LEFT JOIN refs r ON t.title = r.clean_title""", files=PART_FILES_SQL, titles=_TITLES_SQL,
                                      refs=_REFS_SQL))
def a01_match_rate(spark, sf):
    cat = T.cleanup_file_titles(part_files(spark, sf), "midi", True)
    return M.match_rate(M.enrich_titles(cat, _refs(spark, sf)), F.col("song_id").isNotNull())


@register("a01_recognition_rate", with_ctes("""
SELECT count(DISTINCT CASE WHEN song_id IS NOT NULL THEN video_id END) AS matched, count(*) AS total,
       floor((100.0 * count(DISTINCT CASE WHEN song_id IS NOT NULL THEN video_id END) / count(*)) * 1e6 + 0.5) / 1e6 AS rate,
       CAST(floor(100.0 * count(DISTINCT CASE WHEN song_id IS NOT NULL THEN video_id END) / count(*)) AS BIGINT)
       AS rate_int FROM chunks""", chunks=CHUNKS_SQL))
def a01_recognition_rate(spark, sf):
    return M.match_rate(chunks(spark, sf), F.col("song_id").isNotNull(), ["video_id"])


# ---- J2 / J3: entity resolution by token Jaccard -----------------------------------
_TOK = "list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''))"
_J23_SQL = """
q AS (SELECT p_partkey AS qid, {qt} AS toks FROM part),
r AS (SELECT min(p_partkey) AS rid, {rt} AS toks FROM part GROUP BY p_name),
qe AS (SELECT qid, len(toks) AS qn, unnest(toks) AS tok FROM q),
re AS (SELECT rid, len(toks) AS rn, unnest(toks) AS tok FROM r),
sc AS (SELECT * FROM (SELECT qid, rid, count(*) * 1.0 / (max(qn) + max(rn) - count(*)) AS score
       FROM qe JOIN re USING (tok) GROUP BY qid, rid))
SELECT qid AS p_partkey, rid AS song_id, floor((score) * 1e6 + 0.5) / 1e6 AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM sc) WHERE rank <= {k}"""
_Q_TEXT = "p_name || ' ' || p_type"
_R_TEXT = "p_name"


def _j23(spark, sf, k):
    q = read_table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("qt"))
    r = read_table(spark, sf, "part").groupBy(F.col("p_name").alias("rt")).agg(F.min("p_partkey").alias("song_id"))
    return M.resolve_best(q, r, "p_partkey", "qt", "song_id", "rt", k)


def _j23_sql(k):
    return "WITH " + _J23_SQL.format(qt=_TOK.format(x=_Q_TEXT), rt=_TOK.format(x=_R_TEXT), k=k)


@register("j02_resolve_best", _j23_sql(1))
def j02_resolve_best(spark, sf):
    return _j23(spark, sf, 1)


@register("j03_resolve_top50", _j23_sql(50))
def j03_resolve_top50(spark, sf):
    return _j23(spark, sf, 50)


# ---- J4: anti-join append -----------------------------------------------------------
@register("j04_append_new", """SELECT DISTINCT l_orderkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IS NOT NULL)""")
def j04_append_new(spark, sf):
    stored = read_table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("l_orderkey"))
    new = read_table(spark, sf, "lineitem").select("l_orderkey").distinct()
    return M.append_new(new, stored, "l_orderkey")


# ---- J7: exact-name join ------------------------------------------------------------
@register("j07_name_join", """
SELECT m.p_partkey AS midi_id, t.track_id, t.name FROM part m
JOIN (SELECT p_name AS name, min(p_partkey) AS track_id FROM part WHERE p_partkey % 2 = 1 GROUP BY p_name) t
ON m.p_name = t.name WHERE m.p_partkey % 2 = 0""")
def j07_name_join(spark, sf):
    p = read_table(spark, sf, "part")
    tracks = p.filter(F.col("p_partkey") % 2 == 1).groupBy(F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("track_id"))
    cat = p.filter(F.col("p_partkey") % 2 == 0).select(F.col("p_partkey").alias("midi_id"), "p_name")
    return M.name_join(cat, tracks, "p_name", "name").select("midi_id", "track_id", "name")


# ---- J8: pattern join of films (nation names) over playlists (documents) -----------
_PL_SQL = f"""SELECT d.doc_id, {_clean_sql("n.n_name || ' ' || d.text || CASE d.doc_id % 3 WHEN 0 THEN ' Original Soundtrack' WHEN 1 THEN ' film music' ELSE '' END", True)} AS clean_name
FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25"""
_FILMS_SQL = f"SELECT {_clean_sql('n_name', True)} AS film FROM nation"


@register("j08_first_pattern_match", with_ctes("""
SELECT film, doc_id FROM (
  SELECT f.film, p.doc_id, row_number() OVER (PARTITION BY f.film ORDER BY p.doc_id) AS rn
  FROM films f JOIN playlists p ON regexp_matches(p.clean_name, '.*(' || f.film || ').*(soundtrack|film)')
  WHERE f.film <> '') WHERE rn = 1""", playlists=_PL_SQL, films=_FILMS_SQL))
def j08_first_pattern_match(spark, sf):
    d = read_spread(spark, sf, "documents", ["doc_id", "text"])
    n = read_table(spark, sf, "nation")
    suffix = (F.when(F.col("doc_id") % 3 == 0, F.lit(" Original Soundtrack"))
              .when(F.col("doc_id") % 3 == 1, F.lit(" film music")).otherwise(F.lit("")))
    pl = d.join(n, n["n_nationkey"] == d["doc_id"] % 25).select(
        "doc_id", T.clean_title(F.concat("n_name", F.lit(" "), "text", suffix), True).alias("clean_name"))
    films = n.select(T.clean_title("n_name", True).alias("film"))
    return M.first_pattern_match(films, pl, "film", "clean_name", "doc_id").select("film", "doc_id")


# ---- J9: composite-key join -------------------------------------------------------
@register("j09_composite_join", _star_sql("""
SELECT v.id AS clip_id, v.video_id, v.start, o.o_orderkey FROM vcc v
JOIN orders o ON o.o_custkey = v.video_id AND (o.o_orderkey % 97) * 5000 = v.start""", "vcc"))
def j09_composite_join(spark, sf):
    t = star(spark, sf)
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("video_id"),
                                               ((F.col("o_orderkey") % 97) * 5000).alias("start"))
    clips = t["vcc"].select(F.col("id").alias("clip_id"), "video_id", "start")
    return M.composite_join(clips, o, ["video_id", "start"]).select("clip_id", "video_id", "start", "o_orderkey")


# ---- J10 / J11 / J12 / Q8 ----------------------------------------------------------------
# Usable matches: curated as correct, or made-up negatives.
_USABLE = """SELECT x.id, x.clip_id AS wanted, x.real, x.djv_song_id FROM vm x
WHERE x.real = 0 OR EXISTS (SELECT 1 FROM cur c WHERE c.audio_video_match_id = x.id AND c.correct = 1)"""

_J10_SQL = _star_sql(f"""
SELECT u.id, clip.id AS clip_id, pair.index_audio AS audio_id, pair.index_midi AS midi_id, clip.video_id, clip.start,
  clip."end", clip.video_type, right(song.filename, 3) AS audio_type, right(score.filename, 3) AS midi_type,
  song.directory || '/' || song.filename AS audio_file_path,
  score.directory || '/' || score.filename AS midi_file_path,
  film.directory || '/' || film.filename AS video_file_path, u.real, u.djv_song_id
FROM ({_USABLE}) u
LEFT JOIN mam pair USING (djv_song_id)
LEFT JOIN vcc clip ON u.wanted = clip.id
LEFT JOIN ac song ON pair.index_audio = song.id
LEFT JOIN mc score ON pair.index_midi = score.id
LEFT JOIN vc film ON clip.video_id = film.id""", "vm", "vcc", "mam", "ac", "mc", "vc", "cur")


@register("j10_extraction_dirs", _J10_SQL)
def j10_extraction_dirs(spark, sf):
    return TR.extraction_dirs(star(spark, sf))


@register("f06_curated_or_fake", _star_sql("""
SELECT vm.id, vm.real, cur.correct FROM vm LEFT JOIN cur ON cur.audio_video_match_id = vm.id
WHERE cur.correct = 1 OR vm.real = 0""", "vm", "cur"))
def f06_curated_or_fake(spark, sf):
    t = star(spark, sf)
    return TR.curated_or_fake(t["vm"], t["cur"]).select("id", "real", "correct")


_J11_SQL = _star_sql("""
SELECT clip.id, clip.start, clip."end", clip.video_type, song.song_name, film.title, film.directory, film.filename
FROM (SELECT clip_id AS wanted, djv_song_id FROM vm
      WHERE id IN (SELECT audio_video_match_id FROM cur WHERE correct = 1)) u
LEFT JOIN vcc clip ON u.wanted = clip.id
LEFT JOIN vc film ON clip.video_id = film.id
LEFT JOIN songs song ON u.djv_song_id = song.song_id""", "vm", "vcc", "songs", "vc", "cur")


@register("j11_correct_videos", _J11_SQL)
def j11_correct_videos(spark, sf):
    return TR.correct_videos(star(spark, sf))


@register("w20_cropped_videos", f"""
SELECT id, song_name, 'V' || id || '_' || start || '.' || video_type AS target_name, length_s, i * 15 AS chunk_index,
  start / 1000 + i * 15 AS starting_point
FROM (SELECT *, unnest(range(0, CAST(floor(length_s / 15) AS BIGINT))) AS i
      FROM (SELECT *, round_even("end" / 1000 - start / 1000, 0) AS length_s FROM ({_J11_SQL}) v) l
      WHERE length_s >= 15) p""")
def w20_cropped_videos(spark, sf):
    """The clip cropper as one plan: J11 -> T10 (name), T15 (length) -> W20 (whole 15 s pieces)."""
    from reelforge.functions import scalar as X
    from reelforge.operators import timeline as TL
    clips = TR.correct_videos(star(spark, sf)).withColumns({
        "target_name": T.clip_name("id", "start", F.col("video_type")), "length_s": X.clip_length_s("start", "end")})
    return TL.full_chunks(clips, "length_s", F.lit(15), "start").select(
        "id", "song_name", "target_name", "length_s", "chunk_index", "starting_point")


_Q8_SQL = _star_sql(f"""
SELECT u.id, clip.video_id, u.real AS y, sound.*, notes.*, image.*
FROM ({_USABLE}) u
JOIN vf image ON u.wanted = image.clip_id
JOIN vcc clip ON u.wanted = clip.id
LEFT JOIN mam pair USING (djv_song_id)
LEFT JOIN af sound ON pair.index_audio = sound.audio_id
LEFT JOIN sfe notes ON pair.index_midi = notes.midi_id""", "vm", "vcc", "mam", "cur", "af", "sfe", "vf")

_J12_SQL = _star_sql("""
SELECT x.id, x.real, sound.* EXCLUDE (audio_id), notes.* EXCLUDE (midi_id), image.* EXCLUDE (clip_id)
FROM vm x
LEFT JOIN mam pair USING (djv_song_id)
LEFT JOIN af sound ON pair.index_audio = sound.audio_id
LEFT JOIN sfe notes ON pair.index_midi = notes.midi_id
LEFT JOIN (SELECT image.* FROM vf image JOIN vcc clip ON image.clip_id = clip.id) image ON x.clip_id = image.clip_id
""", "vm", "vcc", "mam", "af", "sfe", "vf")


@register("q08_training_table", _Q8_SQL)
def q08_training_table(spark, sf):
    return TR.training_table(star(spark, sf))


@register("j12_feature_join", _J12_SQL)
def j12_feature_join(spark, sf):
    return TR.feature_join(star(spark, sf))


@register("f07_outer_to_inner", _star_sql("""
SELECT vm.id, vf.vf_lines FROM vm LEFT JOIN vf ON vf.clip_id = vm.clip_id WHERE vf.clip_id IS NOT NULL""", "vm", "vf"))
def f07_outer_to_inner(spark, sf):
    t = star(spark, sf)
    j = t["vm"].join(t["vf"], "clip_id", "left").filter(F.col("vf_lines").isNotNull() & F.col("clip_id").isNotNull())
    return j.select("id", "vf_lines")


# ---- J13: back-fill of the fingerprint id ---------------------------------------------
@register("j13_backfill_song_id", _star_sql("""
SELECT m.pair_id, coalesce(m.djv, s.song_id) AS djv_song_id FROM
 (SELECT pair_id, CASE WHEN index_audio % 3 = 0 THEN NULL ELSE djv_song_id END AS djv FROM mam) m
LEFT JOIN (SELECT CASE WHEN strpos(song_name, '_') = 0 THEN '' ELSE left(song_name, strpos(song_name, '_') - 1) END AS k,
                  min(song_id) AS song_id FROM songs GROUP BY 1) s ON s.k = m.pair_id""", "mam", "songs"))
def j13_backfill_song_id(spark, sf):
    t = star(spark, sf)
    mam = t["mam"].select("pair_id", F.when(F.col("index_audio") % 3 == 0, F.lit(None))
                          .otherwise(F.col("djv_song_id")).alias("djv_song_id"))
    return M.backfill_key(mam, t["songs"], "pair_id", T.prefix_before(F.col("song_name")), "djv_song_id", "song_id")


# ---- Q1: work lists ---------------------------------------------------------------
@register("q01_work_list_audio", with_ctes("""
SELECT DISTINCT audio_id, audio_file_path FROM dirs WHERE audio_id IS NOT NULL
AND audio_id NOT IN (SELECT audio_id FROM af WHERE audio_id % 2 = 0)""",
                                           dirs=f"SELECT * FROM ({_J10_SQL})", af=STAR_SQL["af"]))
def q01_work_list_audio(spark, sf):
    t = star(spark, sf)
    done = t["af"].filter(F.col("audio_id") % 2 == 0)
    return TR.work_list(TR.extraction_dirs(t), done, "audio_id", ["audio_file_path"])


@register("q01_work_list_video", with_ctes("""
SELECT DISTINCT clip_id, video_id, start, "end", video_file_path, video_type,
  'V' || clip_id || '_' || start || '.' || video_type AS target_name,
  round_even("end" / 1000 - start / 1000, 0) AS length_s
FROM dirs WHERE clip_id IS NOT NULL AND clip_id NOT IN (SELECT clip_id FROM vf)""",
                                           dirs=f"SELECT * FROM ({_J10_SQL})", vf=STAR_SQL["vf"]))
def q01_work_list_video(spark, sf):
    from reelforge.functions import scalar as X
    t = star(spark, sf)
    wl = TR.work_list(TR.extraction_dirs(t), t["vf"], "clip_id",
                      ["video_id", "start", "end", "video_file_path", "video_type"])
    return wl.withColumns({"target_name": T.clip_name("clip_id", "start", F.col("video_type")),
                           "length_s": X.clip_length_s("start", "end")})


# ---- Q2 / Q3 / Q4 / Q5 / Q6 / Q7 ---------------------------------------------------------
@register("q02_mark_processed", """
SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
  AND o_custkey IS NOT NULL) THEN 1 ELSE 0 END AS searched FROM customer""")
def q02_mark_processed(spark, sf):
    vc = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).alias("searched"))
    done = read_table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("id"))
    return TR.mark_processed(vc, done, "id")


_Q3_VAL = ("CASE WHEN k % 10 = 0 THEN 'NaN'::DOUBLE WHEN k % 10 = 1 THEN 'inf'::DOUBLE "
           "WHEN k % 23 = 2 THEN NULL ELSE value END")


@register("q03_quarantine", f"""
SELECT user_id, count(*) AS n_values, count(*) FILTER (WHERE v IS NULL OR isnan(v) OR isinf(v)) AS n_bad,
  CASE WHEN count(*) FILTER (WHERE v IS NULL OR isnan(v) OR isinf(v)) > 0 THEN 'rejected' ELSE 'valid' END AS status
FROM (SELECT user_id, {_Q3_VAL} AS v FROM
      (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
GROUP BY user_id""")
def q03_quarantine(spark, sf):
    e = read_table(spark, sf, "events").withColumn(
        "k", F.get_json_object("props", "$.k").try_cast("int"))
    k = F.col("k")
    v = (F.when(k % 10 == 0, F.lit(float("nan"))).when(k % 10 == 1, F.lit(float("inf")))
         .when(k % 23 == 2, F.lit(None).cast("double")).otherwise(F.col("value")))
    valid, rejected = TR.quarantine(e.select("user_id", v.alias("v")), "user_id", "v")
    return (valid.withColumn("status", F.lit("valid"))
            .unionByName(rejected.withColumn("status", F.lit("rejected"))))


@register("q04_curation_load", "SELECT doc_id AS audio_video_match_id, quality AS correct FROM labels")
def q04_curation_load(spark, sf):
    raw = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("Correct"))
    return TR.load_curation(raw)


@register("q05_unique_key_check", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def q05_unique_key_check(spark, sf):
    return TR.unique_violations(read_table(spark, sf, "lineitem"), "l_orderkey")


@register("q05_unique_pk_holds", "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def q05_unique_pk_holds(spark, sf):
    return TR.unique_violations(read_table(spark, sf, "orders"), "o_orderkey")


@register("q06_fk_check", """SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)""")
def q06_fk_check(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return TR.fk_violations(li, read_table(spark, sf, "orders"), "l_orderkey", "o_orderkey")


@register("q06_fk_check_clip_video", _star_sql("""SELECT id, video_id FROM vcc
WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT id FROM vc WHERE c_id_ok)""".replace(
    " WHERE c_id_ok", " WHERE id % 2 = 0"), "vcc", "vc"))
def q06_fk_check_clip_video(spark, sf):
    t = star(spark, sf)
    return TR.fk_violations(t["vcc"].select("id", "video_id"), t["vc"].filter(F.col("id") % 2 == 0),
                            "video_id", "id")


@register("q07_surrogate_ids", """
SELECT o_custkey AS video_id, (o_orderkey % 97) * 5000 AS start,
  (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_custkey, (o_orderkey % 97) * 5000, o_orderkey)
  AS id, o_orderkey FROM orders""")
def q07_surrogate_ids(spark, sf):
    o = read_table(spark, sf, "orders")
    clips = o.select(F.col("o_custkey").alias("video_id"), ((F.col("o_orderkey") % 97) * 5000).alias("start"),
                     "o_orderkey")
    mx = o.agg(F.max("o_orderkey").alias("_m")).withColumn("_one", F.lit(1))
    c = clips.withColumn("_one", F.lit(1)).join(F.broadcast(mx), "_one").drop("_one")
    return TR.assign_ids(c, ["video_id", "start", "o_orderkey"], start=F.col("_m") + 1).drop("_m")


# ---- O1-O6 ------------------------------------------------------------------------------
@register("o01_sort_nulls_first", with_ctes("SELECT video_id, start, song_id FROM chunks", chunks=CHUNKS_SQL))
def o01_sort_nulls_first(spark, sf):
    return chunks(spark, sf).select("video_id", "start", "song_id").orderBy(
        F.col("song_id").asc_nulls_first(), "video_id", "start")


@register("o02_first_per_group", """SELECT p_brand, p_partkey, p_name FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def o02_first_per_group(spark, sf):
    p = read_table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return M.first_per_key(p, "p_brand", ["p_partkey"])


@register("o03_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def o03_distinct(spark, sf):
    return read_table(spark, sf, "part").select("p_brand", "p_type").distinct()


@register("o04_union_by_name", """
SELECT p_partkey, p_name, NULL::VARCHAR AS p_brand FROM part WHERE p_size < 25
UNION ALL SELECT p_partkey, NULL::VARCHAR AS p_name, p_brand FROM part WHERE p_size >= 25""")
def o04_union_by_name(spark, sf):
    p = read_table(spark, sf, "part")
    a = p.filter(F.col("p_size") < 25).select("p_partkey", "p_name")
    b = p.filter(F.col("p_size") >= 25).select("p_partkey", "p_brand")
    return a.unionByName(b, allowMissingColumns=True)


@register("o05_set_equality", """
SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right,
  count(*) FILTER (WHERE b.k IS NULL) = 0 AND count(*) FILTER (WHERE a.k IS NULL) = 0 AS equal
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b
ON a.k = b.k""")
def o05_set_equality(spark, sf):
    a = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    b = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return TR.set_equality(a, b, "k")


@register("o06_append_negatives", _star_sql("""
SELECT id, djv_song_id, invalid_mode, real, clip_id FROM vm WHERE real = 1
UNION ALL
SELECT (SELECT max(id) FROM vm WHERE real = 1) + row_number() OVER (ORDER BY clip_id, djv_song_id, id) AS id,
  djv_song_id, 2 AS invalid_mode, 0 AS real, clip_id FROM vm WHERE real = 0""", "vm"))
def o06_append_negatives(spark, sf):
    vm = star(spark, sf)["vm"]
    pos = vm.filter(F.col("real") == 1)
    neg = vm.filter(F.col("real") == 0).select(F.col("id").alias("_src"), "djv_song_id",
                                               F.lit(2).alias("invalid_mode"), F.lit(0).alias("real"), "clip_id")
    out = TR.append_negatives(pos, neg, ["clip_id", "djv_song_id", "_src"])
    return out.drop("_src")


# ---- E1: catalog flow ---------------------------------------------------------------------------
E1_EXCEPT_DIRS = ["Brand#13"]
E1_EXCEPT_FILE = "^small"
_E1_SQL = f"""WITH files AS ({PART_FILES_SQL}),
paths AS (SELECT f.p_partkey, '/music/' || p.p_brand || '/' || f.filename AS path FROM files f JOIN part p USING (p_partkey)),
cat AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, regexp_extract(path, '([^/]*)$', 1) AS filename
        FROM paths),
pruned AS (SELECT * FROM cat WHERE NOT list_has_any(string_split(directory, '/'), ['Brand#13'])
           AND NOT regexp_matches(filename, '{E1_EXCEPT_FILE}')),
titled AS (SELECT * FROM (SELECT directory, filename,
    {_clean_sql("regexp_extract(filename, '" + T.SUFFIX_PATTERNS['midi'] + "', 1)", True)} AS title,
    regexp_replace(regexp_extract(filename, '{T.SUFFIX_PATTERNS['midi']}', 2), '^\\.+|\\.+$', '', 'g') AS file_type
    FROM pruned) WHERE title <> ''),
refs AS ({_REFS_SQL}),
enriched AS (SELECT DISTINCT t.directory, t.filename, t.title, t.file_type, r.song_id, r.spotify_artist, r.spotify_URL
             FROM titled t LEFT JOIN refs r ON t.title = r.clean_title)
SELECT * FROM enriched WHERE filename NOT IN (SELECT filename FROM files WHERE p_partkey % 3 = 0 AND filename IS NOT NULL)"""


@register("j04_catalog_new_files", _E1_SQL)
def j04_catalog_new_files(spark, sf):
    files = part_files(spark, sf)
    brand = read_table(spark, sf, "part").select("p_partkey", "p_brand")
    paths = files.join(brand, "p_partkey").select(
        F.concat(F.lit("/music/"), "p_brand", F.lit("/"), "filename").alias("path"))
    existing = files.filter(F.col("p_partkey") % 3 == 0)
    return M.catalog_new_files(paths, "path", "midi", _refs(spark, sf), existing, True, E1_EXCEPT_DIRS, E1_EXCEPT_FILE)
