"""Queries for fingerprint alignment (R1-R4, F5): benchmark passages inside documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelforge.operators import fingerprint as FP
from reelforge.operators.parallel import read_spread
from reelforge.plans.registry import register
from reelforge.session import read_table

CHUNK = 64
_TOKS = "string_split_regex(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+')"
_IDX_SQL = f"""bt AS (SELECT item_id, {_TOKS.format(x='text')} AS t FROM benchmark),
idx AS (SELECT item_id, i AS pos, d, t[i + 1] || chr(1) || t[i + 1 + d] || chr(1) || d AS key
        FROM bt, unnest(range(len(t))) AS u(i), unnest([1, 2]) AS v(d) WHERE i + d < len(t))"""
def _rec_sql(chunk: int) -> str:
    return _REC_SQL_T.replace("{CHUNK}", str(chunk))


_REC_SQL_T = f"""WITH {_IDX_SQL},
dt AS (SELECT doc_id, {_TOKS.format(x='text')} AS t FROM documents),
q AS (SELECT doc_id, i // {{CHUNK}} AS chunk, i AS qpos, t[i + 1] || chr(1) || t[i + 1 + d] || chr(1) || d AS key
      FROM dt, unnest(range(len(t))) AS u(i), unnest([1, 2]) AS v(d)
      WHERE i + d < len(t) AND i // {{CHUNK}} = (i + d) // {{CHUNK}}),
nq AS (SELECT doc_id, chunk, count(*) AS n FROM q GROUP BY 1, 2),
ch AS (SELECT doc_id, unnest(range(0, (len(t) - 1) // {{CHUNK}} + 1)) AS chunk FROM dt),
vt AS (SELECT q.doc_id, q.chunk, x.item_id, q.qpos - x.pos AS "offset", count(*) AS votes
       FROM q JOIN idx x USING (key) GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY votes DESC, item_id, "offset")
         AS rn FROM vt) WHERE rn = 1),
res AS (SELECT ch.doc_id, CAST(ch.chunk AS BIGINT) AS chunk, b.item_id, b.votes, nq.n, b."offset",
        coalesce(b.votes / nq.n >= 0.01, false) AS ok
        FROM ch LEFT JOIN nq USING (doc_id, chunk) LEFT JOIN best b USING (doc_id, chunk))
"""
_REC_SQL = _rec_sql(CHUNK)


@register("r01_build_index", f"WITH {_IDX_SQL} SELECT item_id, pos, d, key FROM idx")
def r01_build_index(spark, sf):
    return FP.build_index(read_table(spark, sf, "benchmark")).select("item_id", "pos", "d", "key")


@register("r02_recognise_chunks", _REC_SQL + """SELECT doc_id, chunk, CASE WHEN ok THEN item_id END AS item_id,
  CASE WHEN ok THEN floor((votes / n) * 1e6 + 0.5) / 1e6 END AS input_confidence, CASE WHEN ok THEN "offset" END AS "offset",
  CASE WHEN ok THEN votes END AS votes FROM res""")
def r02_recognise_chunks(spark, sf):
    idx = FP.build_index(read_table(spark, sf, "benchmark"))
    return FP.recognise(read_spread(spark, sf, "documents", ["doc_id", "text"]), idx, "doc_id", "text", CHUNK)


@register("f05_recognised_only", _REC_SQL + """SELECT doc_id, chunk, item_id, "offset" FROM res WHERE ok""")
def f05_recognised_only(spark, sf):
    r = r02_recognise_chunks(spark, sf)
    return r.filter(F.col("item_id").isNotNull()).select("doc_id", "chunk", "item_id", "offset")


@register("r04_index_new_items", f"""WITH {_IDX_SQL}
SELECT item_id, count(*) AS n_hashes FROM idx WHERE item_id % 2 = 1 GROUP BY 1""")
def r04_index_new_items(spark, sf):
    items = read_table(spark, sf, "benchmark")
    existing = FP.build_index(items.filter(F.col("item_id") % 2 == 0))
    new = FP.index_new_items(items, existing)
    return new.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_hashes"))


# ---- the segment finder: recognition -> segmentation -> clips ---------------------------------
FINDER_CHUNK = 16


def _recognised_chunks(spark, sf):
    idx = FP.build_index(read_table(spark, sf, "benchmark"))
    rec = FP.recognise(read_spread(spark, sf, "documents", ["doc_id", "text"]), idx, "doc_id", "text", FINDER_CHUNK)
    return rec.select(F.col("doc_id").alias("video_id"), (F.col("chunk") * 5000).alias("start"),
                      ((F.col("chunk") + 1) * 5000).alias("end"), F.col("item_id").cast("int").alias("song_id"),
                      F.col("offset").cast("double").alias("offset_seconds"))


def _finder_sql(body: str) -> str:
    from reelforge.plans import q_segments as QS
    chunks = """SELECT doc_id AS video_id, chunk * 5000 AS start, (chunk + 1) * 5000 AS "end",
  CAST(CASE WHEN ok THEN item_id END AS INTEGER) AS song_id, CAST(CASE WHEN ok THEN "offset" END AS DOUBLE) AS offset_seconds
  FROM res"""
    ctes = {"chunks": chunks, "n1": QS._N1, "sm": QS._SM, "n2": QS._N2, "tg": QS._TG, "df": QS._DF,
            "segrows": QS._SEGROWS, "modes": QS._MODES,
            "seg": """SELECT s.video_id, s.match_id, s.song_id, s.start, s."end", m.invalid_mode
  FROM (SELECT video_id, match_id, song_id, count(*) AS n, min(start) AS start, max("end") AS "end"
        FROM segrows GROUP BY 1, 2, 3) s JOIN modes m USING (video_id, match_id) WHERE s.n >= 3"""}
    return _rec_sql(FINDER_CHUNK).rstrip() + ",\n" + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n" + body


@register("w08_recognised_segments", _finder_sql("SELECT * FROM seg"))
def w08_recognised_segments(spark, sf):
    """W8 over the R2 recognition of every 64-token chunk of every document."""
    from reelforge.operators import segments as SEG
    return SEG.segment_timeline(_recognised_chunks(spark, sf))


@register("q07_segment_clips", _finder_sql("""SELECT row_number() OVER (ORDER BY video_id, start) AS clip_id, video_id,
  start, "end", 'mp4' AS video_type FROM (SELECT DISTINCT video_id, start, "end" FROM seg)"""))
def q07_segment_clips(spark, sf):
    from reelforge.operators import segments as SEG
    from reelforge.operators.training import store_segments
    clips, _ = store_segments(SEG.segment_timeline(_recognised_chunks(spark, sf)))
    return clips.select(F.col("id").alias("clip_id"), "video_id", "start", "end", "video_type")


@register("j09_segment_matches", _finder_sql("""SELECT s.song_id AS djv_song_id, s.invalid_mode, 1 AS real, c.clip_id
FROM seg s JOIN (SELECT row_number() OVER (ORDER BY video_id, start) AS clip_id, video_id, start
                 FROM (SELECT DISTINCT video_id, start, "end" FROM seg)) c USING (video_id, start)"""))
def j09_segment_matches(spark, sf):
    from reelforge.operators import segments as SEG
    from reelforge.operators.training import store_segments
    _, matches = store_segments(SEG.segment_timeline(_recognised_chunks(spark, sf)))
    return matches


def _finder_segments(spark, sf):
    from reelforge.operators import segments as SEG
    return SEG.segment_timeline(_recognised_chunks(spark, sf))


@register("q07_finder_second_run", _finder_sql("""SELECT (SELECT coalesce(max(id), 0) FROM old)
  + row_number() OVER (ORDER BY video_id, start) AS clip_id, video_id, start, "end", 'mp4' AS video_type
FROM (SELECT * FROM clip c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.video_id = c.video_id AND o.start = c.start))""")
          .replace("\nSELECT (SELECT coalesce", """,
clip AS (SELECT DISTINCT video_id, start, "end" FROM seg),
old AS (SELECT row_number() OVER (ORDER BY video_id, start) AS id, * FROM clip WHERE video_id % 2 = 0)
SELECT (SELECT coalesce"""))
def q07_finder_second_run(spark, sf):
    """The finder run again over all videos when those with even ids are
    stored: only clips not stored yet, with ids after the stored ones."""
    from reelforge.operators.training import store_segments
    found = _finder_segments(spark, sf)
    stored, _ = store_segments(found.where(F.col("video_id") % 2 == 0))
    clips, _ = store_segments(found, existing_clips=stored)
    return clips.select(F.col("id").alias("clip_id"), "video_id", "start", "end", "video_type")


@register("q02_finder_processed", _finder_sql("""SELECT d.doc_id AS id, CASE WHEN d.doc_id IN (SELECT video_id FROM seg)
  THEN 1 ELSE 0 END AS searched FROM documents d"""))
def q02_finder_processed(spark, sf):
    """Q2 at the end of the finder: the videos that gave a segment are marked."""
    from reelforge.operators.training import mark_processed
    videos = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("searched"))
    return mark_processed(videos, _finder_segments(spark, sf).select(F.col("video_id").alias("id")), "id")


@register("t19_recognition_fields", _REC_SQL + """SELECT r.doc_id, r.chunk, r.item_id, decode(encode(b.text)) AS song_name,
  floor((r.votes / r.n) * 1e6 + 0.5) / 1e6 AS input_confidence, r."offset"
FROM res r JOIN benchmark b ON b.item_id = r.item_id WHERE r.ok""")
def t19_recognition_fields(spark, sf):
    """T19 on recognition results: pick the fields and decode the item name from its UTF-8 bytes."""
    from reelforge.functions.scalar import decode_utf8
    rec = r02_recognise_chunks(spark, sf).filter(F.col("item_id").isNotNull())
    names = read_table(spark, sf, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("name_bytes"))
    return rec.join(names, "item_id").select("doc_id", "chunk", "item_id", decode_utf8("name_bytes").alias("song_name"),
                                             "input_confidence", "offset")
