"""License scan: an exact set-similarity join of text blocks with templates.

Tokens are pairs of neighbouring words, so words count only in their order and
side by side.  A block is a window of BLOCK words that begins every STRIDE words, so every
passage of up to BLOCK - STRIDE words lies whole in one block; templates of
more words have blocks and strides twice, four times ... as long (``stride``),
so each lies whole in one of its blocks.  A block is a candidate for a
template if it holds at least CONTAINMENT of the template's distinct pairs.
Pairs are ordered by their number of places in the whole corpus, rarest
first.  Filters, none of which loses a candidate:

* prefix: it must hold one of the template's first |T| - need + 1 pairs;
* positional: if the first of them found has rank i, at most |T| - i pairs
  are left to find, which must reach the need;
* length: the block must hold at least ``need`` distinct template pairs of
  any kind.

Candidates are verified by counting and then confirmed by name: the pairs that
name the licence (``must``) all stand in the block, and none of those that name
a sister licence (``never``).  Licences share most of their wording, so
containment alone would take one for another.

Only pairs of templates are kept from the texts, with their positions, in one
pass over the corpus; only documents that hold a prefix pair are exploded.
Everything is DataFrame functions; the templates are a constant list and the
only broadcast.  Phrases of two words or more are found on the same kept
pairs, one after the other.

Defined results: a null text is empty; a document without words has no
places, no labels, score 0 and null first and last word; a null id is
carried; equal rows are scanned separately; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelforge.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STRIDE, CONTAINMENT = 64, 32, 0.8


class Template(NamedTuple):
    text: str
    label: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


# Phrases, then public licence texts, notices and statements in
# their usual wording (names and years of holders left out).
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
_AS_IS = """this software is provided by the copyright holders and contributors as is and any express or implied
warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose
are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
special exemplary or consequential damages including but not limited to procurement of substitute goods or services
loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution"""
_GNU = """is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by
the free software foundation either version 3 of the license or at your option any later version"""
_HOPE = """is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu {name} for more details"""
_CC = "this work is licensed under a creative commons {name} 4 0 international license"
TEMPLATES = (
    Template("released under the mit license", "mit", ("mit license",)),
    Template("""permission is hereby granted free of charge to any person obtaining a copy of this software and
associated documentation files the software to deal in the software without restriction including without limitation
the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and
this permission notice shall be included in all copies or substantial portions of the software the software is provided
as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software""", "mit", ("to deal", "copy modify")),
    Template("""permission to use copy modify and or distribute this software for any purpose with or without fee is
hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software""",
             "isc", ("author disclaims", "without fee")),
    Template(f"{_BSD} {_AS_IS}", "bsd-2-clause", ("binary form",), ("endorse or",)),
    Template(f"""{_BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission {_AS_IS}""", "bsd-3-clause",
             ("binary form", "endorse or")),
    Template("licensed under the apache license version 2 0", "apache", ("apache license",)),
    Template("""licensed under the apache license version 2 0 the license you may not use this file except in compliance
with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
warranties or conditions of any kind either express or implied see the license for the specific language governing
permissions and limitations under the license""", "apache", ("apache license",)),
    Template("""this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was
not distributed with this file you can obtain one at https mozilla org mpl 2 0""", "mpl", ("mozilla public",)),
    Template("licensed under the mozilla public license version 2 0", "mpl", ("mozilla public",)),
    *(Template(f"this {kind} {rule.format(name=name)}", label, (pair,))
      for kind, name, label, pair in (
          ("program", "general public license", "gpl", "gnu general"),
          ("library", "lesser general public license", "lgpl", "gnu lesser"),
          ("program", "affero general public license", "agpl", "gnu affero"))
      for rule in (_GNU, f"{_GNU} this {kind} {_HOPE}")),
    *(Template(f"licensed under the gnu {name} version 3", label, (pair,)) for name, label, pair in (
        ("general public license", "gpl", "gnu general"), ("lesser general public license", "lgpl", "gnu lesser"),
        ("affero general public license", "agpl", "gnu affero"))),
    *(Template(_CC.format(name=name), f"cc-{code}", (pair, f"{name.split()[-1]} 4"), never)
      for name, code, pair, never in (
          ("attribution", "by", "commons attribution", ()),
          ("attribution sharealike", "by-sa", "attribution sharealike", ("attribution noncommercial",)),
          ("attribution noncommercial", "by-nc", "attribution noncommercial", ()),
          ("attribution noncommercial sharealike", "by-nc-sa", "noncommercial sharealike", ()),
          ("attribution noderivatives", "by-nd", "attribution noderivatives", ("attribution noncommercial",)),
          ("attribution noncommercial noderivatives", "by-nc-nd", "noncommercial noderivatives", ()))),
    *(Template(f"licensed under cc {code} 4 0", f"cc-{code.replace(' ', '-')}", (f"{code.split()[-1]} 4", f"cc {code.split()[0]}",
                                                                               *pairs))
      for code, pairs in (("by", ()), ("by sa", ("by sa",)), ("by nc", ("by nc",)), ("by nc sa", ("by nc", "nc sa")),
                          ("by nd", ("by nd",)), ("by nc nd", ("by nc", "nc nd")))),
)


def pairs_of(text: str) -> list[str]:
    """The pairs of neighbouring words of a phrase or template."""
    words = re.findall(WORD, text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def need(size: int) -> int:
    return math.ceil(CONTAINMENT * size - 1e-9)


def stride(words: int) -> int:
    """The stride of a template's blocks, which are BLOCK / STRIDE times as long."""
    out = STRIDE
    while words > out * (BLOCK // STRIDE - 1):
        out *= 2
    return out


def words_of(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def kept_pairs(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """(row, id, n_words, kept): the places of the vocabulary's pairs in every
    whole text, in order."""
    words = words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    firsts = sorted({v.split()[0] for v in vocabulary})
    pair = F.transform(F.col("words"), lambda w, i: F.when(w.isin(firsts), F.struct(
        i.cast("long").alias("at"), F.concat_ws(" ", w, F.get(F.col("words"), i + 1)).alias("word"))))
    return (docs.select(F.col(id_col).alias("id"), words.alias("words"))
            .select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"),
                    F.filter(pair, lambda x: x["word"].isin(vocabulary)).alias("kept")))


def phrase_places(kept: Column, phrases=PHRASES) -> Column:
    """(start, label) of every place where a phrase's words stand in a row:
    its pairs one after the other."""
    def found(phrase: str, label: str) -> Column:
        parts = pairs_of(phrase)
        if not parts:
            raise ValueError("a phrase has two words at least")

        def here(x: Column, i: Column) -> Column:
            out = x["word"] == parts[0]
            for j, pair in enumerate(parts[1:], 1):
                after = F.get(kept, i + j)
                out = out & F.coalesce((after["word"] == pair) & (after["at"] == x["at"] + j), F.lit(False))
            return out

        return F.transform(F.filter(kept, here), lambda x: F.struct(x["at"].alias("at"), F.lit(label).alias("label")))

    return F.concat(*[found(p, label) for p, label in phrases])


def template_rows(templates=TEMPLATES) -> list[tuple]:
    """(template, label, token, size, need, stride, counts, must, never, musts):
    a template's distinct pairs, and pairs that only confirm it."""
    out = []
    for i, t in enumerate(templates):
        t = Template(*t)
        own, words = sorted(set(pairs_of(t.text))), len(pairs_of(t.text)) + 1
        for token in sorted({*own, *t.must, *t.never}):
            out.append((i, t.label, token, len(own), need(len(own)), stride(words), int(token in own),
                        int(token in t.must), int(token in t.never), len(set(t.must))))
    return out


def template_tokens(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """:func:`template_rows` as a constant table."""
    values = ", ".join(str(r) for r in template_rows(templates))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, token, size, need, stride, counts, must, never, musts)")


def ranked(tokens: DataFrame, kept: DataFrame) -> DataFrame:
    """The template tokens with their rank by places in the corpus."""
    places = kept.select(F.explode("kept.word").alias("token")).groupBy("token").agg(F.count("*").alias("places"))
    # Pairs that only confirm come behind all others.
    rarest = Window.partitionBy("template").orderBy(F.col("counts").desc(), F.coalesce("places", F.lit(0)), "token")
    return tokens.join(places, "token", "left").withColumn("rank", F.row_number().over(rarest) - 1).drop("places")


def block_matches(kept: DataFrame, order: DataFrame, strides: list[int]) -> DataFrame:
    """(row, stride, block, template, label, containment) of every matching
    block; ``strides``: those of the templates."""
    prefix = order.where("rank <= size - need")
    rare = prefix.agg(F.collect_set("token").alias("rare"))  # at most all template tokens
    some = kept.join(F.broadcast(rare), F.arrays_overlap(F.col("kept.word"), F.col("rare"))).drop("rare")

    def blocks(n: int) -> Column:
        last = F.floor(F.col("k.at") / n)
        return F.transform(F.sequence(F.greatest(F.lit(0), last - (BLOCK // STRIDE - 1)), last),
                           lambda b: F.struct(F.lit(n).alias("stride"), b.alias("block")))

    places = (some.select("row", F.explode("kept").alias("k"))
              .select("row", F.col("k.word").alias("token"), F.explode(F.concat(*map(blocks, strides))).alias("b"))
              .select("row", "token", "b.stride", "b.block").distinct())
    key = ["row", "stride", "block"]
    first = (places.join(F.broadcast(prefix), ["token", "stride"]).groupBy(*key, "template", "size", "need")
             .agg(F.min("rank").alias("rank")).where("size - rank >= need").drop("rank"))
    length = places.groupBy(*key).agg(F.count("*").alias("tokens"))
    candidates = first.join(length, key).where("tokens >= need").drop("tokens", "size")
    own = F.broadcast(order.select("template", "label", "token", "size", "counts", "must", "never", "musts"))
    return (places.join(candidates, key).join(own, ["template", "token"])
            .groupBy(*key, "template", "label", "size", "need", "musts")
            .agg(F.sum("counts").alias("found"), F.sum("must").alias("named"), F.sum("never").alias("others"))
            .where("found >= need AND named = musts AND others = 0")
            .select(*key, "template", "label", (F.col("found") / F.col("size")).alias("containment")))


def scan(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
         phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``places`` (phrases),
    ``matched`` (labels of templates), ``containment`` (the best, 0 if none)."""
    rows = template_rows(templates)
    vocabulary = sorted({r[2] for r in rows} | {p for text, _ in phrases for p in pairs_of(text)})
    kept = stored(kept_pairs(docs, id_col, text_col, vocabulary), folder, "kept")
    order = ranked(template_tokens(docs.sparkSession, templates), kept)
    strides = sorted({r[5] for r in rows}) or [STRIDE]
    found = (block_matches(kept, order, strides).groupBy("row")
             .agg(F.collect_set("label").alias("matched"), F.max("containment").alias("containment")))
    return (kept.select("row", "id", "n_words", phrase_places(F.col("kept"), phrases).alias("places"))
            .join(found, "row", "left")
            .select("id", "n_words", "places",
                    F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
                    F.coalesce("containment", F.lit(0.0)).alias("containment")))
