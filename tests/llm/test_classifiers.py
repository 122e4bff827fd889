"""Toxicity and quality: held-out accuracy, calibration, and what scoring looks at."""

import zlib

import numpy as np
import pytest

from shelfmark.llm import quality, toxicity


@pytest.fixture(scope="module")
def labelled(given):
    labels = {i: (q, t) for i, q, t in given("sf0.1", "labels", "doc_id, quality, toxic")}
    rows = [(i, text, *labels[i]) for i, text in given("sf0.1", "documents", "doc_id, text") if i in labels]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    return learn, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]


def test_toxic_texts_are_told_apart(labelled):
    learn, apart = labelled
    toxic, clean = [r for r in learn if r[3]], [r for r in learn if not r[3]][:1500]
    some = sorted(toxic + clean, key=lambda r: zlib.crc32(str(r[0]).encode()))
    model = toxicity.fit_texts([r[1] for r in some], [r[3] for r in some], len(toxic) / len(learn))
    y = np.array([r[3] for r in apart])
    p = np.array([toxicity.score(model, r[1]) for r in apart]) >= 0.5
    assert (p == y).mean() > 0.96 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.02
    assert toxicity.score(model, None) == toxicity.score(model, "") == toxicity.score(model, "?!") < 0.5


def test_pooling_does_not_depend_on_stretches(labelled, monkeypatch):
    learn, _ = labelled
    some = learn[:200]
    model = toxicity.fit_texts([r[1] for r in some], [r[3] for r in some], 0.1, toxicity.Settings(epochs=1))
    texts = [r[1] for r in some[:40]]
    whole = [toxicity.logit(model, t) for t in texts]
    monkeypatch.setattr(toxicity, "stretches", lambda data, overlap: toxicity_stretches(data, overlap, 50))
    cut = [toxicity.logit(model, t) for t in texts]
    assert [k for _, k in whole] == [k for _, k in cut]
    assert np.allclose([z for z, _ in whole], [z for z, _ in cut], atol=1e-5)


toxicity_stretches = toxicity.stretches


def test_filters_see_neighbours_and_any_place():
    r = np.random.default_rng(8)
    filler = lambda n: " ".join(f"w{i}" for i in r.integers(0, 400, n))
    texts = [f"{filler(r.integers(1, 12))} {'not ' if k % 2 else ''}bad {filler(r.integers(1, 12))}" for k in range(300)]
    y = [int(k % 2 == 0) for k in range(300)]
    model = toxicity.fit_texts(texts, y, 0.5, toxicity.Settings(epochs=20))
    got = [toxicity.score(model, t) >= 0.5 for t in ("fresh words bad here", "fresh words not bad here", "so much more is said and then bad it was")]
    assert got == [True, False, True]


def test_quality_is_told_apart(labelled):
    learn, apart = labelled
    x = np.array([quality.measure(r[1]) for r in learn])
    y = np.array([r[2] for r in learn], dtype=float)
    model = quality.fit_rows(x, y, y.mean())
    got = quality.score_rows(model, np.array([quality.measure(r[1]) for r in apart])) >= 0.3
    want = np.array([r[2] for r in apart]) == 1
    assert (got == want).mean() > 0.98 and got[want].mean() > 0.99


def test_scores_are_sums_of_tables():
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair explains it
    model = quality.fit_rows(x, y, 0.5, quality.Settings(rounds=20, pairs=1, pair_rounds=100))
    assert model.pairs == ((0, 1),)
    score = quality.score_rows(model, x)
    assert ((score > 0.5) == y).mean() > 0.85
    k = 17
    z = model.intercept + sum(t[np.searchsorted(c, x[k, j], side="right")] for j, (c, t) in enumerate(zip(model.cuts, model.tables)))
    z += model.pair_tables[0][np.searchsorted(model.pair_cuts[0], x[k, 0], side="right"), np.searchsorted(model.pair_cuts[1], x[k, 1], side="right")]
    assert np.isclose(score[k], 1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("operator,label", [(toxicity, "toxic"), (quality, "quality")])
def test_unusual_documents(spark, documents, operator, label):
    texts = [(k, f"plain words number {k} of the text" if k % 2 else f"awful!!! @@@ ### junk ### {k} ###") for k in range(1, 120)]
    docs = documents(*texts, (200, None), (201, ""), (None, "plain words"), (202, "plain words " * 50_000), (1, "plain words"))
    labels = spark.createDataFrame([(k, k % 2 if label == "quality" else 1 - k % 2) for k, _ in texts] + [(None, 1), (3, None), (999, 0), (2, 7)], f"doc_id long, {label} int")
    rows = operator.classify(docs, labels).collect()
    assert len(rows) == len(texts) + 5
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[None].held_out and by[200].score == by[201].score
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    good = {k: r.predicted for k, r in by.items() if k is not None and k < 120 and k > 1}
    assert np.mean([p == (k % 2 if label == "quality" else 1 - k % 2) for k, p in good.items()]) > 0.9
    assert operator.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in operator.classify(docs, labels.limit(0)).collect()} == {0.0}
