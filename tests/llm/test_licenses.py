import random
import re

from helpers import ODD_TEXTS, documents, words, write

from reelforge.llm import licenses as L
from reelforge.llm.common import shared_folder
from reelforge.llm.q_licenses import op9_license_scan

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=L.TEMPLATES):
    w = word_list(text)
    places = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    best, labels = 0.0, set()
    for template in templates:
        t, pairs = L.Template(*template), set(L.pairs_of(template[0]))
        stride = L.stride(len(word_list(t.text)))
        for begin in range(0, max(1, len(w)), stride):
            block = {f"{x} {y}" for x, y in zip(w[begin:], w[begin + 1:begin + 2 * stride + 1])}
            if len(block & pairs) >= L.need(len(pairs)) and block >= set(t.must) and not block & set(t.never):
                labels.add(t.label)
                best = max(best, len(block & pairs) / len(pairs))
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if places else round(best, 6))


#: Sentences and the labels that they must have, base phrases included.
SISTERS = {
    "Released under the GNU General Public License": "gpl",
    "released under the Apache License": "apache",
    "Licensed under the Mozilla Public License, Version 2.0": "mpl",
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-NC-ND 4.0.": "cc-by-nc-nd",
    "The film was released under the label, with a license from the studio": "",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) "
    "any later version.": "gpl,lgpl",  # gpl is a base phrase of that sentence
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version.": "agpl,gpl",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "Released under the MIT license": "mit",
    "You may use this file under the terms of any license, with or without fee, and the author is happy.": "",
    "The software is provided by the school, and permission to use the pool is hereby granted to any person": "",
}


def texts():
    rng = random.Random(8)
    out = ODD_TEXTS + ["MIT License", "mit  LICENSE-mit license apache\nLicense", "GNU General Public License",
                       "license mit", "mit the license", "mit license" * 3, "é mit license é"]
    for template, *_ in L.TEMPLATES:
        t = template.split()
        for drop in range(5):
            gone = rng.sample(range(len(t)), min(drop * (1 + len(t) // 40), len(t)))
            keep = [x for i, x in enumerate(t) if i not in gone]
            if drop == 4:
                rng.shuffle(keep)
            for lead in (0, 25, 31, 33, 70, 300):
                out.append(words(lead, lead) + " " + " ".join(keep).upper() + ". " + words(40, drop))
    out.append(" ".join("the of and under a version 2 0 3 to in" for _ in range(40)))
    out.append(" ".join("released " + words(70, i) + " license" for i in range(5)))
    return out


def test_query_matches_brute_force(spark, scratch):
    all_texts = texts()
    write(documents(spark, all_texts, extra=True).repartition(4), scratch, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in op9_license_scan(spark, scratch).collect()}
    assert got == {i: brute(t) for i, t in enumerate(all_texts)}


def test_sister_licences_and_prose_get_their_own_labels(spark, scratch):
    for t, labels in SISTERS.items():
        assert brute(t)[5] == labels, t
    padded = [f"{words(50, i)}. {t} {words(90, i)}" for i, t in enumerate(SISTERS)]
    write(documents(spark, padded), scratch, "documents")
    got = {r.doc_id: r.labels for r in op9_license_scan(spark, scratch).collect()}
    assert got == dict(enumerate(SISTERS.values()))


def test_whole_texts_have_one_label_each(spark):
    for t in L.TEMPLATES:
        found = set(brute(t.text)[5].split(","))
        base = set(brute(t.text)[4].split(","))
        assert t.label in found and found - base <= {t.label}, t.text[:60]


def test_filters_lose_no_match_for_any_order(spark):
    """The join finds what counting all blocks finds, whatever tokens are rare."""
    for common in ("mit", "the", "license"):
        all_texts = texts() + [f"{common} " * 300]
        df = documents(spark, all_texts)
        rows = L.scan(df, shared_folder(spark, "t")).collect()
        want = {i: brute(t) for i, t in enumerate(all_texts)}
        for r in rows:
            assert round(max(r.containment, 1.0 if r.places else 0.0), 6) == want[r.id][6], all_texts[r.id]


def test_native_plan_repeated_rows_and_empty_table(spark):
    df = documents(spark, ["MIT License", "MIT License", None], ids=[3, 3, None])
    found = L.scan(df, shared_folder(spark, "t"))
    rows = sorted((str(r.id), r.n_words, len(r.places)) for r in found.collect())
    assert rows == [("3", 2, 1), ("3", 2, 1), ("None", 0, 0)]
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
    assert L.scan(df.limit(0), shared_folder(spark, "t")).collect() == []


def test_long_templates_match_at_every_offset(spark):
    templates = [(" ".join(f"{name}{i}" for i in range(n)), name) for name, n in (("a", 150), ("b", 60), ("c", 5))]
    all_texts = [f"{words(lead, lead)} {t} {words(40, lead)}" for t, _ in templates for lead in range(257)]
    all_texts += [words(600, 1), " ".join(templates[0][0].split()[:119])]
    rows = L.scan(documents(spark, all_texts), shared_folder(spark, "t"), templates=templates).collect()
    want = {i: ([templates[i // 257][1]], 1.0) if i < 771 else ([], 0.0) for i in range(len(all_texts))}
    assert {r.id: (r.matched, r.containment) for r in rows} == want
