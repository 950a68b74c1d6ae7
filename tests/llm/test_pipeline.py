import collections

import __spark_entry__
import corpus_pipeline
import numpy as np
from helpers import ODD_TEXTS, WORD, crc_fold, documents, words, write

from reelforge.llm import classifier, mixing, rules
from reelforge.llm.common import shared_folder, stored
from reelforge.llm.q_classifier import training_rows
from test_classifier import JUNK
from test_neardup import shingles
from test_packing import ids_of


def corpus(spark, folder, extra=False):
    texts = list(ODD_TEXTS)
    for i in range(120):
        text = JUNK[i % 3](i) if i % 6 == 0 else words(25 + i % 90, i, 10**6).capitalize()
        texts += [text] * (1 + i % 3) + ([text + " and more"] if i % 4 == 1 else [])
    labels = [(i, int(not any(t == JUNK[j % 3](j) for j in range(0, 120, 6))), 0) for i, t in enumerate(texts) if i > 12]
    df = documents(spark, texts, extra=extra, ids=[None] + list(range(1, len(texts))),
                   sources=[None if i % 7 == 0 else f"s{i % 4}" for i in range(len(texts))])
    write(df, folder, "documents")
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")
    return texts


def test_stages_match_brute_force(spark, scratch):
    texts = corpus(spark, scratch, extra=True)
    docs = spark.read.parquet(f"{scratch}/documents.parquet")
    columns, folder = docs.columns, shared_folder(spark, "t")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, scratch), folder, name)
        steps.append((name, before, docs.collect()))
        assert docs.columns == columns or name == "packing"
    by = {name: (before, after) for name, before, after in steps}

    def key(r):
        return (r.doc_id, r.text)

    before, after = by["quality_classifier"]
    x = classifier.vectors(spark.read.parquet(f"{scratch}/documents.parquet"))
    model = classifier.train(training_rows(x, spark.read.parquet(f"{scratch}/labels.parquet")))
    good = {r.doc_id for r in classifier.scored(x, model).collect() if r.score >= 0.3}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.doc_id in good)

    before, after = by["quality_rules"]
    ok = {r.doc_id for r in rules.judged(spark.createDataFrame(before, docs_schema(spark, scratch))).collect() if r.kept}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.doc_id in ok)

    before, after = by["minhash_near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert sorted(r.doc_id for r in after) == sorted(i for i in sets if root(i) == i)

    before, after = by["source_mixing"]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    taken = collections.Counter(r.doc_id for r in after)
    assert max(taken.values()) <= 2 and set(taken) <= set(size)
    target = {r.source: r["_mx_target"] for r in mixing.curriculum(
        spark.createDataFrame(before, docs_schema(spark, scratch))).collect()}
    words_of = collections.Counter()
    for r in after:
        words_of[r.source] += size[r.doc_id]
    for s, t in target.items():
        assert abs(words_of[s] - t) <= max(size[r.doc_id] for r in before if r.source == s)

    before, after = by["packing"]
    pieces = [r.asDict() for r in after]
    total = collections.Counter(r.doc_id for r in before)
    whole = {r.doc_id: ids_of(r.text) + [1] for r in before}
    lengths = collections.Counter()
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
        assert p["ids"] == np.array(whole[p["doc_id"]][p["start"]:p["start"] + p["length"]], "<u4").tobytes()
    assert lengths == {i: n * len(whole[i]) for i, n in total.items()}


def docs_schema(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").schema


def test_run_and_registration(spark, scratch):
    corpus(spark, scratch)
    out = corpus_pipeline.run(spark, scratch)
    assert out.count() > 0 and "sequence_id" in out.columns
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()


def test_empty_documents(spark, scratch):
    corpus(spark, scratch)
    empty = spark.read.parquet(f"{scratch}/documents.parquet").limit(0)
    folder = shared_folder(spark, "t")
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, scratch), folder, name)
        assert docs.collect() == []


def test_sequence_ids_follow_the_training_order(spark, scratch):
    df = documents(spark, [words(10 + i * 37 % 400, i) for i in range(600)], sources=["a" if i % 2 else "b" for i in range(600)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = corpus_pipeline.mix(spark, df, scratch)
        order = [r.doc_id for r in mixed.collect()]
        docs = stored(mixed, shared_folder(spark, "t"), "mixed")
        assert len(docs.inputFiles()) > 3
        pieces = corpus_pipeline.pack(spark, docs, scratch).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    once = {d: order.index(d) for d, n in collections.Counter(order).items() if n == 1}
    tasks = collections.defaultdict(set)
    for p in pieces:
        if p.doc_id in once:
            tasks[p.sequence_id >> 40].add(once[p.doc_id])
    spans = [(min(x), max(x)) for _, x in sorted(tasks.items())]
    assert len(spans) > 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
