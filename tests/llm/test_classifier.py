import numpy as np
import pyarrow as pa
from helpers import ODD_TEXTS, crc_fold, documents, words, write

from reelforge.llm import classifier
from reelforge.llm.q_classifier import op10_quality_classifier, training_rows
from reelforge.llm.textstats import Texts

JUNK = [lambda i: "%%% ".join(words(60, i).split()), lambda i: words(80, i).upper().replace(" ", "!! "),
        lambda i: " ".join(w + (" " + w) * 9 for w in words(15, i).split())]


def corpus(n):
    texts = [JUNK[i % 3](i) if i % 6 == 0 else words(20 + i % 200, i).capitalize() + "." for i in range(n)]
    return texts, [int(i % 6 != 0) for i in range(n)]


def features(texts):
    return np.concatenate([classifier.features(t) for _, _, t in Texts.of(pa.array(texts, pa.string()))])


def test_scores_equal_the_definition(spark, scratch):
    texts, y = corpus(200)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(y)], "doc_id long, quality int, toxic int")
    vectors = classifier.vectors(documents(spark, texts))
    model = classifier.train(training_rows(vectors, labels))
    train = np.array([crc_fold(i) != 0 for i in range(200)])
    x = features(texts)
    diff = direct_from(x, np.array(y), train)
    got = {r.doc_id: r.score for r in classifier.scored(vectors, model).collect()}
    want = 1 / (1 + np.exp(-np.clip(diff, -700, 700)))
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-9)


def direct_from(x, y, train):
    """Log odds straight from the definition."""
    out = {}
    xt, yt = x[train], y[train]
    n = {k: (yt == k).sum() for k in (0, 1)}
    mean = {k: xt[yt == k].mean(0) for k in n}
    cov = {k: np.cov(xt[yt == k].T, bias=True) for k in n}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / len(yt)
    whole = np.cov(xt.T, bias=True)
    for k in n:
        c = (1 - classifier.SHRINK_POOLED) * cov[k] + classifier.SHRINK_POOLED * pooled
        c = (1 - classifier.SHRINK_DIAGONAL) * c + classifier.SHRINK_DIAGONAL * np.diag(np.diag(c))
        c = c + classifier.RIDGE * np.diag(np.maximum(np.diag(whole), 1e-3))
        d = x - mean[k]
        out[k] = np.log(n[k] / len(yt)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)
    return out[1] - out[0]


def test_held_out_accuracy_and_contract(spark, scratch):
    texts, y = corpus(600)
    write(documents(spark, texts), scratch, "documents")
    # Held-out labels are wrong on purpose: learning from them would show.
    labels = [(i, q if crc_fold(i) else 1 - q, 0) for i, q in enumerate(y)]
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), scratch, "labels")
    rows = op10_quality_classifier(spark, scratch).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc_fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_texts_labels_and_empty_tables(spark):
    df = documents(spark, ODD_TEXTS, extra=True)
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (10, 0, 0), (8, None, 1), (None, 1, 0), (7, 5, 0)],
                                   "doc_id long, quality int, toxic int")
    vectors = classifier.vectors(df)
    model = classifier.train(training_rows(vectors, labels))
    scores = classifier.scored(vectors, model).collect()
    assert len(scores) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in scores)
    good = classifier.good_documents(df, model)
    assert good.columns == df.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores if r.score >= 0.3}
    none = classifier.train(training_rows(vectors, labels.limit(0)))
    assert {r.score for r in classifier.scored(vectors, none).collect()} == {0.5}
    assert classifier.scored(classifier.vectors(df.limit(0)), model).collect() == []
    both = features(["a b c"] * 4)
    assert np.isfinite(classifier.fit({k: (2.0, both[:2].sum(0), both[:2].T @ both[:2]) for k in (0, 1)}).score(both)).all()
