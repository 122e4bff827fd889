"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Learned with follow-the-regularised-leader and elastic-net penalties; its confidence is
calibrated with a temperature.

Defined results: NULL, empty or letterless text is ``und`` with score 0; repeated rows are
scored alike; with no labelled row at all every text is ``und``; columns other than
``text`` are never looked at when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import held_out, per_text, sample_by_class, texts_of

UNDETERMINED = "und"
RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
# Characters of a text that are hashed at a time: bounds memory for texts of any length.
STRETCH = 1 << 18


@dataclass(frozen=True)
class Settings:
    per_class: int = 1200  # the bound of the learning sample, for each language
    bits: int = 15  # n-grams are hashed to 2**bits features
    longest: int = 3
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 1e-4
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # features x languages, times the inverse document frequency
    idf: np.ndarray
    temperature: float
    settings: Settings


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)


def ngram_counts(text: str, settings: Settings) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased letters, runs of others taken as one space.

    None if there is no letter.
    """
    size = 1 << settings.bits
    counts = np.zeros(size, dtype=np.int64)
    letters, found, tail = _letters(), False, np.array([32], dtype=np.uint32)
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        is_letter = letters[codes]
        found = found or bool(is_letter.any())
        codes = np.where(is_letter, codes, np.uint32(32))
        before = np.concatenate([[tail[-1] != 32], is_letter[:-1]])
        codes = np.concatenate([tail, codes[is_letter | before]])
        # the tail was counted with the stretch before, so only n-grams that end in new characters count
        old = len(tail)
        for n in range(1, settings.longest + 1):
            ends = np.arange(max(old, n - 1), len(codes))
            if len(ends):
                h = np.full(len(ends), n, dtype=np.uint32)
                for back in range(n - 1, -1, -1):
                    h = h * np.uint32(0x9E3779B1) + codes[ends[0] - back : len(codes) - back]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                counts += np.bincount(h >> np.uint32(32 - settings.bits), minlength=size)
        tail = codes[-(settings.longest - 1) :] if settings.longest > 1 else codes[-1:]
    return counts if found else None


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts > 0)
    values = (1.0 + np.log(counts[at])) * idf[at]
    return at, values / np.sqrt(values @ values)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_weights(examples: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, settings: Settings) -> np.ndarray:
    """Follow the regularised leader, a coordinate at a time, with L1 and L2 penalties."""
    z = np.zeros((1 << settings.bits, n_classes))
    n = np.zeros_like(z)

    def leader(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        pull = np.sign(zs) * settings.l1 - zs
        return np.where(np.abs(zs) <= settings.l1, 0.0, pull / ((settings.beta + np.sqrt(ns)) / settings.alpha + settings.l2))

    order = np.random.default_rng(7)
    for _ in range(settings.epochs):
        for k in order.permutation(len(examples)):
            at, x = examples[k]
            w = leader(at)
            p = _softmax(x @ w)
            p[classes[k]] -= 1.0
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = more
    return leader(np.arange(1 << settings.bits))


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    Each class counts as seen once more than it was, so n texts without an error claim
    no more than (n + 1) / (n + classes), and the search does not run to its bound.
    """
    n, n_classes = logits.shape

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return float(-(n * logs[np.arange(n), classes].sum() + logs.sum()) / (n + n_classes))

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequency(texts: DataFrame, settings: Settings) -> tuple[int, np.ndarray]:
    """In how many of all learnable texts each hashed n-gram occurs: one partial count a task, added by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = 0, np.zeros(1 << settings.bits, dtype=np.int64)
        for batch in batches:
            for part in texts_of(batch.column(0)):
                for text in part:
                    counts = ngram_counts(text, settings)
                    if counts is not None:
                        seen += 1
                        total += counts > 0
        at = np.flatnonzero(total)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], seen), pa.int64())], ["feature", "n"])

    rows = texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << settings.bits, dtype=np.int64)
    seen = 0
    for r in rows:  # at most a row for each feature
        if r["feature"] < 0:
            seen = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return seen, df


def fit(documents: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Learn from ``text`` and ``lang`` of the rows for which ``learn`` holds.

    Document frequencies cover all those rows; the weights come from a sample of about
    ``settings.per_class`` texts a language (at most twice that), chosen by a hash of ``doc_id``.
    """
    known = documents.filter(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    seen, df = document_frequency(known.select("text"), settings)
    idf = np.log((1.0 + seen) / (1.0 + df)) + 1.0
    rows = sample_by_class(known, "lang", ["doc_id"], settings.per_class).select("text", "lang").collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    examples, classes = [], []
    for r in rows:
        counts = ngram_counts(r["text"], settings)
        if counts is not None:
            examples.append(_features(counts, idf))
            classes.append(languages.index(r["lang"]))
    if not examples:
        return Model((), np.zeros((1 << settings.bits, 0)), idf, 1.0, settings)
    y = np.array(classes)
    apart = np.arange(len(examples)) % 5 == 0  # for the temperature
    use = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(examples))
    weights = fit_weights([examples[k] for k in use], y[use], len(languages), settings)
    logits = np.array([x @ weights[at] for at, x in (examples[k] for k in np.flatnonzero(apart))])
    return Model(languages, weights.astype(np.float32), idf, fit_temperature(logits, y[apart]), settings)


def predict(model: Model, text: str | None) -> tuple[str, float]:
    counts = ngram_counts(text, model.settings) if text else None
    if counts is None or not model.languages:
        return UNDETERMINED, 0.0
    at, x = _features(counts, model.idf)
    p = _softmax((x @ model.weights[at]).astype(float) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def language(documents: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct column of ``lang_pred`` and ``score`` for a text column of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda t: predict(known, t)

    return per_text(make, RESULT, F.col(text))


def identify(documents: DataFrame, folds: int = 4, which: int = 2, settings: Settings = Settings()) -> DataFrame:
    """Predicted language of every document: doc_id, held_out, lang_pred, score."""
    out = held_out(F.col("doc_id"), folds, which)
    model = fit(documents, ~out, settings)
    rows = documents.select("doc_id", "text")
    return rows.select("doc_id", out.alias("held_out"), language(rows, model).alias("_found")).select("doc_id", "held_out", "_found.*")
