"""Title and text cleaning as Column expressions.

All functions return Spark ``Column`` expressions built from JVM built-ins
(regexp_replace / split / filter / array_join), so they stay inside
whole-stage code generation; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Tokens removed from file titles (must equal the original list for equal titles).
FILENAME_STOPWORDS = [
    "bdrip", "brrip", "1080p", "720p", "aac",
    "www", "yifi", "yts", "anoxmous", "bluray", "hdtv", "org", "rcg", "jh", "rg2",
    "webrip", "criterion", "dvdrip", "x264", "xvid", "gaz", "bz2", "da", "dc", "dwb", "jc2",
    "dm", "kar", "karaoke", "version", "jpp", "jk", "mc", "rt", "gw", "gc9", "bb", "gp", "gl",
    "mix", "remix", "dj", "nr", "song", "k", "gr", "cm", "v1", "mw", "rw", "bz3", "v2", "fs",
    "yify", "ehhhh", "blu", "ray", "vppv", "rip", "enc", "amzn",
]
# File name -> (title stem, suffix) per modality; unanchored, greedy stem.
SUFFIX_PATTERNS = {
    "midi": r"(.*)(\.mid|\.MID|\.Mid)",
    "audio": r"(.*)(\.mp3|\.wav|\.MP3|\.WAV)",
    "video": r"(.*)(\.mp4|\.mkv|\.avi)",
}
# Camel / Pascal case boundary: lower before upper, or upper before Upper+lower; the empty place before an upper.
CAMEL_BOUNDARY = r"(?=[A-Z])(?:(?<=[a-z])|(?<=[A-Z])(?=[A-Z][a-z]))"
# --------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_special(c, allow_numbers: bool = True) -> Column:
    """Every run of non-alphanumerics (non-letters) becomes one space.
    The ASCII classes mean ``[^A-Za-z0-9]+`` / ``[^A-Za-z]+``, whose negated
    union of ranges Java matches ten times slower."""
    return F.regexp_replace(_c(c), r"\P{Alnum}+" if allow_numbers else r"\P{Alpha}+", " ")


def split_camel(c) -> Column:
    """``fooBarHTMLParser`` -> ``foo Bar HTML Parser``."""
    return F.regexp_replace(_c(c), CAMEL_BOUNDARY, " ")


def tokens(c) -> Column:
    """Whitespace tokens (Python ``str.split()`` without arguments): split on
    whitespace runs and drop the empty strings a leading / trailing run leaves."""
    return F.array_remove(F.split(_c(c), r"\s+"), "")


def remove_stopwords(c, stopwords=None) -> Column:
    """T5: drop listed tokens, re-join with single spaces."""
    stop = list(FILENAME_STOPWORDS if stopwords is None else stopwords)
    # isin over > 10 literals becomes a hash-set lookup (InSet), not a scan per token
    kept = F.filter(tokens(c), lambda w: ~w.isin(stop) & (w != F.lit("")))
    return F.array_join(kept, " ")


def collapse_spaces(c) -> Column:
    """Runs of two or more whitespace characters become one space."""
    return F.regexp_replace(_c(c), r"\s\s+", " ")


def clean_title(c, allow_numbers: bool = True, stopwords=None) -> Column:
    """T4: T3 -> camel split -> lower -> T5 -> T6."""
    return collapse_spaces(remove_stopwords(F.lower(split_camel(replace_special(c, allow_numbers))), stopwords))


def cleanup_file_titles(df: DataFrame, file_type: str, allow_numbers: bool = False,
                        filename: str = "filename") -> DataFrame:
    """Add ``title`` and ``file_type``; rows whose name has no suffix of
    the modality, or whose title cleans to '', are dropped."""
    if file_type not in SUFFIX_PATTERNS:
        raise ValueError(f"unknown modality {file_type!r}; expected one of {sorted(SUFFIX_PATTERNS)}")
    pat = SUFFIX_PATTERNS[file_type]
    stem = F.regexp_extract(F.col(filename), pat, 1)
    suffix = F.regexp_extract(F.col(filename), pat, 2)
    out = df.withColumns({
        "title": clean_title(stem, allow_numbers),
        "file_type": F.regexp_replace(suffix, r"^\.+|\.+$", ""),
    })
    return out.filter(F.col("title") != "")


def stopword_candidates(df: DataFrame, text: str = "text", n: int = 20, max_len: int = 4) -> DataFrame:
    """The ``n`` most frequent whitespace tokens shorter than ``max_len``
    characters.  Ties at the cut are broken by token (ascending) instead of
    first-seen order, so the answer does not depend on row order.  The count
    is a partial (map-side) aggregate; only ``n`` rows reach the final sort."""
    toks = df.select(F.explode(tokens(text)).alias("token")).filter(
        (F.length("token") < max_len) & (F.col("token") != ""))
    return (toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
            .orderBy(F.col("freq").desc(), F.col("token")).limit(n))


# ---- names and paths (T8-T14) ---------------------------------------------------
def pair_id(left_prefix: str, left_id, right_prefix: str, right_id) -> Column:
    """``M<midi>A<audio>`` / ``V<video>A<audio>``; ids printed as integers."""
    return F.concat(F.lit(left_prefix), _c(left_id).cast("long").cast("string"),
                    F.lit(right_prefix), _c(right_id).cast("long").cast("string"))


def new_file_name(pair, old_name) -> Column:
    """``<pair_id>_<old name>``."""
    return F.concat(_c(pair).cast("string"), F.lit("_"), _c(old_name).cast("string"))


def clip_name(clip_id, start, video_type) -> Column:
    """``V<clip>_<start>.<type>``."""
    return F.concat(F.lit("V"), _c(clip_id).cast("string"), F.lit("_"), _c(start).cast("string"),
                    F.lit("."), _c(video_type))


def cropped_target_name(directory, name, index, suffix) -> Column:
    """Directory + name without its last 4 characters + ``__<index><suffix>``."""
    n = _c(name)
    return F.concat(_c(directory), F.left(n, F.greatest(F.length(n) - 4, F.lit(0))), F.lit("__"),
                    _c(index).cast("string"), _c(suffix))


def path_join(directory, filename) -> Column:
    """``directory/filename``; null if either side is null (as SQL CONCAT)."""
    return F.concat(_c(directory), F.lit("/"), _c(filename))


def type_suffix(c, n: int = 3) -> Column:
    """Last ``n`` characters."""
    return F.right(_c(c), F.lit(n))


def prefix_before(c, sep: str = "_") -> Column:
    """Text before the first ``sep``; '' when there is none (LEFT/LOCATE)."""
    x = _c(c)
    return F.left(x, F.locate(sep, x) - 1)
