import zlib

import numpy as np

from shelfmark.llm import language_id
from shelfmark.llm.language_id import Settings

SMALL = Settings(per_class=300)


def test_counts_do_not_depend_on_stretches(monkeypatch):
    text = "Ünder the Löwe 12 -- 漢字 straße " * 30
    whole = language_id.ngram_counts(text, SMALL)
    monkeypatch.setattr(language_id, "STRETCH", 7)
    assert np.array_equal(whole, language_id.ngram_counts(text, SMALL))


def test_counts_are_those_of_all_ngrams():
    letters = " ab c "
    counts = language_id.ngram_counts("AB, c!", SMALL)
    # one n-gram ends in every character after the leading space, unless it would begin before it
    assert counts.sum() == sum(1 for n in (1, 2, 3) for k in range(len(letters) - n + 1)) - 1
    assert np.array_equal(counts, language_id.ngram_counts("ab\n\n 7 C ", SMALL))
    assert language_id.ngram_counts("12 ?!", SMALL) is None


def test_elastic_net_leaves_useless_features_at_zero():
    r = np.random.default_rng(1)
    examples, classes = [], []
    for k in range(400):
        y = k % 2
        at = np.array([y, 2 + int(r.integers(0, 50))])
        examples.append((at, np.array([0.7, 0.7])))
        classes.append(y)
    w = language_id.fit_weights(examples, np.array(classes), 2, Settings(l1=0.5))
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert (w[100:] == 0).all()


def test_temperature_undoes_overconfidence():
    r = np.random.default_rng(2)
    truth = r.normal(0, 1, (4000, 3))
    p = np.exp(truth) / np.exp(truth).sum(axis=1, keepdims=True)
    y = np.array([r.choice(3, p=row) for row in p])
    assert abs(language_id.fit_temperature(5 * truth, y) - 5) < 0.8


def test_no_errors_give_no_certainty():
    y = np.arange(40) % 4
    t = language_id.fit_temperature(10 * np.eye(4)[y], y)
    p = np.exp(10 / t) / (np.exp(10 / t) + 3)
    assert abs(p - 41 / 44) < 0.005


def test_held_out_accuracy_and_folds(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(documents, settings=SMALL).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    apart = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in apart]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_unusual_documents(documents):
    rows = [(k, "the house and the garden of it", "en") for k in range(1, 30)] + [(k, "das Haus und der Garten nicht", "de") for k in range(30, 60)]
    rows += [(60, None), (61, ""), (62, "12 34 !?"), (63, "the house", None), (None, "der Garten", "en"), (64, "the garden " * 40_000, "en"), (1, "the house and the garden of it", "en")]
    docs = documents(*rows)
    got = {}
    for r in language_id.identify(docs, settings=SMALL).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
    assert [got[k][0][0] for k in (60, 61, 62)] == ["und"] * 3
    assert got[63][0][0] == "en" and got[64][0][0] == "en"
    assert got[None] == [("de", True)]
    assert len(got[1]) == 2
    assert language_id.identify(docs.limit(0), settings=SMALL).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents((1, "abc", None), (2, "abc", None)), settings=SMALL).collect()} == {"und"}
