"""Catalog enrichment, entity resolution and catalog matching.

Scale notes
* Catalog match (J5/J6) reduces each side to one row per key *before* the
  join, so a key shared by many files never produces an n x m blow-up.
* Lookup tables are never force-broadcast; the planner broadcasts a side only
  when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
  and AQE re-plans at run time from actual sizes.
* The pattern join (J8) is an equi-join on the grams that begin a pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelforge.functions.scalar import r6

from reelforge.functions import text as T


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """O2 / J6 helper: the first row per key by an explicit total order.

    Implemented as ``min_by(struct(row), struct(order))``, a partial
    aggregate, so a hot key is reduced map-side instead of being sorted in one
    task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordk).alias("_r"))
            .select(*keys, "_r.*"))


def enrich_titles(catalog: DataFrame, refs: DataFrame, title: str = "title", ref_key: str = "clean_title",
                  ref_id: str = "song_id") -> DataFrame:
    """Left join every catalog row to the reference song resolved for its
    title; the reference side is first reduced to one row per key (lowest id),
    which also removes the duplicate-title blow-up of the original (N4)."""
    one = first_per_key(refs, ref_key, [ref_id])
    return catalog.join(one, catalog[title] == one[ref_key], "left").drop(ref_key)


#: Scores tried first, from high to low; what they cannot settle is scored in full.
RESOLVE_STEPS = (0.6, 0.3)


def resolve_best(queries: DataFrame, refs: DataFrame, q_id: str, q_text: str, r_id: str, r_text: str,
                 k: int = 1, steps: Sequence[float] = RESOLVE_STEPS) -> DataFrame:
    """Best ``k`` references per query title by token Jaccard score,
    whatever the score (at least one shared token), ties by reference id.

    Equal titles are resolved once, on both sides.  The thresholds of
    ``steps`` are tried in turn: candidates come from prefix filtering, which
    is exact for a threshold t (two sets with J >= t share a token among the
    first ``n - ceil(t * n) + 1`` tokens of each, in a rarest-first order).  A
    title that has ``k`` references of at least t is settled and leaves; the
    titles left at the end meet every reference that shares a token."""
    def sets(df, txt):
        words = F.array_distinct(F.filter(T.tokens(F.lower("_x")), lambda w: w != ""))
        return df.select(F.col(txt).alias("_x")).where(F.col("_x").isNotNull()).distinct().select(
            "_x", words.alias("_t"))

    qs = sets(queries, q_text)
    rs = sets(refs, r_text).withColumnsRenamed({"_x": "_y", "_t": "_u"})
    # The k smallest ids of a reference title are all that can be among its best k.
    first = Window.partitionBy(r_text).orderBy(r_id)
    ids = (refs.select(r_text, r_id).where(F.col(r_text).isNotNull()).distinct()
           .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
           .select(F.col(r_text).alias("_y"), F.col(r_id).alias("_id")))
    freq = rs.select(F.explode("_u").alias("_tok")).groupBy("_tok").agg(F.count(F.lit(1)).alias("_df"))

    def ordered(ts, name, words):
        e = ts.select(name, F.explode(words).alias("_tok")).join(freq, "_tok", "left").fillna(0, subset=["_df"])
        return e.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_df", "_tok"))).alias("_o"))  # one title's tokens

    def listed(o, name, t):
        keep = F.size("_o") - F.ceil(F.size("_o") * t) + 1 if t else F.size("_o")
        part = F.slice("_o", F.lit(1), F.least(F.size("_o"), keep).cast("int"))
        return o.select(name, F.explode(part).alias("_p")).select(name, F.col("_p._tok").alias("_tok"))

    qo, ro = ordered(qs, "_x", "_t"), ordered(rs, "_y", "_u")

    def best(open_, t):
        pairs = listed(qo.join(open_, "_x", "left_semi"), "_x", t).join(listed(ro, "_y", t), "_tok").select(
            "_x", "_y").distinct()
        common = F.size(F.array_intersect("_t", "_u"))
        scored = (pairs.join(qs, "_x").join(rs, "_y")
                  .select("_x", "_y", (common / (F.size("_t") + F.size("_u") - common)).alias("score"))
                  .where(F.col("score") >= (t or 0.0)))
        w = Window.partitionBy("_x").orderBy(F.col("score").desc(), F.col("_id"))
        return (scored.join(ids, "_y").withColumn("rank", F.row_number().over(w).cast("long"))
                .where(F.col("rank") <= k).select("_x", "_id", "score", "rank"))

    open_, out = qs.select("_x"), None
    for t in [*steps, 0]:
        found = best(open_, t)
        if t:
            settled = found.groupBy("_x").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select("_x")
            found, open_ = found.join(settled, "_x", "left_semi"), open_.join(settled, "_x", "left_anti")
        out = found if out is None else out.union(found)
    return (queries.select(q_id, F.col(q_text).alias("_x")).join(out, "_x")
            .select(q_id, F.col("_id").alias(r_id), r6("score").alias("score"), "rank"))


def append_new(new: DataFrame, existing: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (``left_anti``: unlike
    ``NOT IN`` it has no null trap).  Running it twice appends nothing."""
    keys = [key] if isinstance(key, str) else list(key)
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def match_catalogs(left: DataFrame, right: DataFrame, key: str, left_id: str = "id", right_id: str = "id",
                   suffixes: tuple[str, str] = ("_midi", "_audio"), first_only: bool = True) -> DataFrame:
    """J5 + J6: inner equi-join of two catalogs on a canonical key with
    suffixed columns.  ``first_only`` keeps the first match per key (lowest
    left id, then lowest right id), and does so by reducing each side to its
    first row per key *before* joining: one output row per key, no n x m."""
    ls, rs = suffixes
    lk = left.select(*[F.col(c).alias(c if c == key else c + ls) for c in left.columns])
    rk = right.select(*[F.col(c).alias(c if c == key else c + rs) for c in right.columns])
    if first_only:
        lk = first_per_key(lk, key, [left_id + ls])
        rk = first_per_key(rk, key, [right_id + rs])
    return lk.join(rk, key, "inner")


def count_matches(left: DataFrame, right: DataFrame, key: str, id_col: str = "id",
                  names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """The equi-join of two catalogs, told per key: rows on either side,
    pairs the join has, and the first id of each side.  Both sides are counted
    before they meet, so a key with n and m rows costs one row, not n x m."""
    a, b = names
    one = left.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{a}"), F.min(id_col).alias(f"first_{a}"))
    two = right.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{b}"), F.min(id_col).alias(f"first_{b}"))
    return (one.join(two, key).withColumn("n_pairs", F.col(f"n_{a}") * F.col(f"n_{b}"))
            .select(key, f"n_{a}", f"n_{b}", "n_pairs", f"first_{a}", f"first_{b}"))


def name_join(tracks: DataFrame, catalog: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Exact-name inner join."""
    return tracks.join(catalog, tracks[left_on] == catalog[right_on], "inner")


def _own_grams(word: Column) -> Column:
    """Grams that key a word of a pattern: its three-character substrings, or
    the whole of a shorter word."""
    size = F.least(F.length(word), F.lit(3))
    return F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(word, i, size))


def first_pattern_match(patterns: DataFrame, texts: DataFrame, pat_col: str, text_col: str, text_order: str,
                        suffix_regex: str = "(soundtrack|film)") -> DataFrame:
    """For each pattern (a cleaned film name, used as a regex as the
    original does) the first text by ``text_order`` matching
    ``.*(<pattern>).*<suffix_regex>``.

    Both are words with spaces between them, so a text that holds a pattern
    holds each word of the pattern inside one of its own, and with it all grams
    of that word (three characters, or the whole of a shorter word).  Each
    pattern is keyed by its gram that the fewest texts hold, so patterns that
    all begin alike do not meet all texts that hold that beginning; a pattern
    with a gram that no text holds is settled.  A text's distinct grams, of the
    sizes that patterns have, come from one regex pass and are exploded without
    the text, which candidates get back by its key; a gram that very many texts
    and patterns share is one skewed join key (AQE splits it)."""
    pat, text = F.col(pat_col), F.col(text_col)
    pats = patterns.filter(pat != "").select(pat_col).distinct()
    own = (pats.select(pat_col, F.explode(F.split(pat, " ")).alias("_w"))
           .select(pat_col, F.explode(_own_grams(F.col("_w"))).alias("_g")).distinct())
    sizes = own.agg(F.collect_set(F.length("_g")).alias("_sizes"))  # one row: at most 0, 1, 2, 3
    # Texts are dealt once, and both readers below take them from that exchange; into a named number of parts,
    # since the work is in the grams and not in the bytes by which parts would be put together.
    key = F.xxhash64(text_order, text_col)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = texts.repartition(parts, key).withColumn("_t", key)

    cut = F.transform("_sizes", lambda n: F.regexp_extract_all(
        text, F.concat(F.lit("(?=([^ ]{"), n.cast("string"), F.lit("}))")), F.lit(1)))
    # The suffix is a condition inside the row: as a filter it would be moved below, to make every text twice.
    inside = F.when(F.regexp_like(text, F.lit(suffix_regex)), F.array_distinct(F.flatten(cut)))
    grams = (some.crossJoin(F.broadcast(sizes)).select("_t", F.explode(inside).alias("_g"))
             .join(own.select("_g").distinct(), "_g", "left_semi")
             .repartition(parts, "_g", "_t"))  # made once, read by the counts and by the candidates
    held = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (own.join(held, "_g", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).groupBy(pat_col)
              .agg(F.min(F.struct("_n", "_g")).alias("_k")).where("_k._n > 0")
              .select(pat_col, F.col("_k._g").alias("_g")))
    cand = grams.join(rarest, "_g").select(pat_col, "_t").distinct().join(some, "_t")
    # ``.*(p).*(suffix)`` holds iff p occurs and the suffix occurs after the
    # end of p's first occurrence: a linear test, no regex backtracking over
    # long texts (clean names are literal [a-z0-9 ] strings).
    first = F.instr(text, pat)
    after = F.substring(text, first + F.length(pat), F.lit(2_147_483_647))
    found = F.coalesce((first > 0) & F.regexp_like(after, F.lit(suffix_regex)), F.lit(False))  # see above: no filter
    hits = cand.filter(found)  # on a null text moves below the exchange, so that both readers share it
    # One aggregate a column: a caller that drops the text does not carry it through the sort by patterns.
    place = F.struct(text_order)
    return hits.groupBy(pat_col).agg(*[F.min_by(c, place).alias(c)
                                       for c in (text_order, *(c for c in texts.columns if c != text_order))])


def composite_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on a composite key."""
    return left.join(right, list(keys), "inner")


def backfill_key(target: DataFrame, source: DataFrame, target_key: str, source_key: Column,
                 fill_col: str, source_val: str) -> DataFrame:
    """``UPDATE t JOIN s ON s_key = t_key SET t.col = s.val WHERE t.col IS
    NULL`` as a left join + coalesce (a rewrite of the whole table, the
    set-based equivalent of the in-place update).  The source is reduced to
    one value per key first (the lowest) so the update is deterministic."""
    s = source.select(source_key.alias("_k"), F.col(source_val).alias("_v")).groupBy("_k").agg(F.min("_v").alias("_v"))
    j = target.join(s, target[target_key] == s["_k"], "left")
    return j.withColumn(fill_col, F.coalesce(F.col(fill_col), F.col("_v").cast(target.schema[fill_col].dataType))
                        ).drop("_k", "_v")


def match_rate(df: DataFrame, matched: Column, distinct_cols: Sequence[str] | None = None) -> DataFrame:
    """A1: 100 * matched / total in one pass (distinct matched rows when
    ``distinct_cols`` is given); null when there are no rows; also the integer
    percentage as printed."""
    if distinct_cols:
        num = F.count_distinct(*[F.when(matched, F.col(c)) for c in distinct_cols])
    else:
        num = F.count(F.when(matched, 1))
    out = df.agg(num.alias("matched"), F.count(F.lit(1)).alias("total"))
    rate = F.try_divide(100.0 * F.col("matched"), F.col("total"))
    return out.select("matched", "total", r6(rate).alias("rate"), F.floor(rate).alias("rate_int"))


def catalog_new_files(paths: DataFrame, path_col: str, modality: str, refs: DataFrame, existing: DataFrame,
                      allow_numbers: bool = True, except_dir=(), except_file: str = "") -> DataFrame:
    """The catalog flow as one plan: split paths into directory /
    file name (S1), prune directories and files (S2, S3), keep files of the
    modality with their cleaned titles (T1, T4), attach the resolved
    reference song (J1), full-row distinct (O3) and keep only file names not
    stored yet (J4)."""
    from reelforge.sources.files import catalog_from_paths, prune_catalog
    cat = prune_catalog(catalog_from_paths(paths, path_col), except_dir, except_file)
    titled = T.cleanup_file_titles(cat.select("directory", "filename"), modality, allow_numbers)
    enriched = enrich_titles(titled, refs).distinct()
    return append_new(enriched, existing.select("filename"), "filename")
