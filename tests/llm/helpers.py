"""Small inputs that every operator must handle."""

import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what operators compute.
CLASHING = ", size long, id long, node string, n_words long, position double, x string, block long, key long, value string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def documents(spark, texts, extra=False, ids=None, sources=None):
    rows = []
    for i, t in enumerate(texts):
        row = [i if ids is None else ids[i], t, "en", f"s{i % 3}" if sources is None else sources[i], len(t or "")]
        rows.append(tuple(row + ([7, 7, "n", 7, 0.5, "x", 7, 7, "v"] if extra else [])))
    return spark.createDataFrame(rows, DOCS + (CLASHING if extra else ""))


def words(n, seed=0, kinds=997):
    """n invented words, the same for the same seed."""
    return " ".join(f"w{zlib.crc32(f'{seed}-{i}'.encode()) % kinds}" for i in range(n))


ODD_TEXTS = [None, "", " \n\t ", "one", "one two three", "\x1c \x85 \xa0 odd\x0bblanks", words(30), words(30),
             words(5000, 3), "x" * 200_000, "%%% ### &&& " * 40, "é🙂 中文 " * 20]


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder


def crc_fold(doc_id, mod=5):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod
