"""Toxicity: a convolutional text classifier.

Hashed word embeddings, filters of several widths and max pooling over the whole text,
trained in numpy; the decision threshold is calibrated for each language, which is guessed
from the text's own function words.  A score of 0.5 is the threshold.

Defined results: NULL, empty and wordless text pools to nothing and scores below 0.5 unless
all of the labelled sample is toxic; repeated rows are scored alike; without labelled rows
every score is 0.  Columns other than ``text`` are never looked at when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import held_out, is_learned, learning_texts, per_text
from shelfmark.llm.words import hashes_of, plain, stretches, word_hashes

# Frequent function words of the languages with a threshold of their own.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be", "by", "on", "this", "are", "from", "at", "an"),
    "de": ("der", "die", "und", "das", "von", "zu", "den", "mit", "ist", "ein", "eine", "nicht", "auf", "für", "sich", "dem", "des", "im"),
    "fr": ("le", "la", "les", "des", "et", "est", "dans", "que", "qui", "une", "du", "pour", "par", "sur", "pas", "avec", "au", "ce"),
    "es": ("el", "los", "las", "que", "y", "una", "del", "por", "con", "para", "se", "no", "su", "al", "lo", "como", "más", "es"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
SLOT_BITS = 18
# A word is the sum of the embeddings of its whole and of its first bytes, so that inflected and compound forms are known.
BEGINNINGS = (4, 6)


@dataclass(frozen=True)
class Settings:
    per_class: int = 1500  # the bound of the learning sample, for each label
    dimensions: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    least_texts: int = 4  # a hashed word in fewer sampled texts shares the embedding of rare words
    epochs: int = 10
    rate: float = 0.02
    decay: float = 1e-4
    hidden_words: float = 0.5  # share of whole words taken for rare ones in training, so that beginnings are learned as well
    seed: int = 5


@dataclass(frozen=True)
class Model:
    row_of_slot: np.ndarray  # a line for whole words and for each beginning: hash slot -> row of ``products``; 0 pads, 1 is rare
    products: np.ndarray  # embeddings times every position of every filter
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    widths: tuple[int, ...]
    filters: int
    language_of_slot: np.ndarray
    thresholds: np.ndarray  # by language
    scale: float


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _language_table() -> np.ndarray:
    table = np.full(1 << SLOT_BITS, len(LANGUAGES) - 1, dtype=np.int8)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        table[_slots(hashes_of([w.encode() for w in words]))] = k
    return table


def _slot_parts(text: str | None, overlap: int) -> Iterator[tuple[np.ndarray, int]]:
    """Slots of a text's words, a stretch at a time, and how many of the words come again.

    A column for the whole word and one for each beginning, which is -1 if it is the whole.
    """
    for part, starts, ends, keep in stretches(plain(text.lower()) if text else b"", overlap):
        columns = [_slots(word_hashes(part, starts, ends))]
        for n in BEGINNINGS:
            columns.append(np.where(ends - starts > n, _slots(word_hashes(part, starts, np.minimum(starts + n, ends))), -1))
        yield np.stack(columns, axis=1), keep


def _rows(row_of_slot: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return np.stack([np.where(slots[:, k] < 0, 0, table[slots[:, k]]) for k, table in enumerate(row_of_slot)], axis=1)


def _language(table: np.ndarray, counts: np.ndarray) -> int:
    return int(counts[:-1].argmax()) if counts[:-1].any() else len(LANGUAGES) - 1


def _pool(products: np.ndarray, rows: np.ndarray, widths: tuple[int, ...], filters: int, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter over all positions, and where.

    The end of a text is padded; a stretch before the last ends where the next one begins.
    """
    ahead = max(widths) - 1
    n = max(1, len(rows) if last else len(rows) - ahead)
    padded = np.concatenate([rows, np.zeros((max(0, n + ahead - len(rows)), rows.shape[1]), dtype=rows.dtype)])
    found = products[padded[:, 0]]
    for k in range(1, rows.shape[1]):
        found += products[padded[:, k]]
    best, at, column = [], [], 0
    for w in widths:
        response = found[:n, column : column + filters].copy()
        for j in range(1, w):
            response += found[j : j + n, column + j * filters : column + (j + 1) * filters]
        at.append(response.argmax(axis=0))
        best.append(response[at[-1], np.arange(filters)])
        column += w * filters
    return np.concatenate(best), np.concatenate(at)


def logit(model: Model, text: str | None) -> tuple[float, int]:
    """The raw score of a whole text and the number of its language."""
    best = None
    counts = np.zeros(len(LANGUAGES), dtype=np.int64)
    for slots, keep in _slot_parts(text, max(model.widths) - 1):
        counts += np.bincount(model.language_of_slot[slots[: len(slots) - keep, 0]], minlength=len(LANGUAGES))
        if keep == len(slots):  # a stretch so short that the next one holds all of it
            continue
        pooled, _ = _pool(model.products, _rows(model.row_of_slot, slots), model.widths, model.filters, keep == 0)
        best = pooled if best is None else np.maximum(best, pooled)
    hidden = np.maximum((best if best is not None else np.zeros_like(model.bias)) + model.bias, 0.0)
    return float(hidden @ model.dense) + model.offset, _language(model.language_of_slot, counts)


def score(model: Model | None, text: str | None) -> float:
    if model is None:
        return 0.0
    z, language = logit(model, text)
    return float(1.0 / (1.0 + np.exp(-np.clip((z - model.thresholds[language]) * model.scale, -40, 40))))


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.v, self.t = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        self.value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _train(texts: list[np.ndarray], y: np.ndarray, n_rows: int, settings: Settings) -> tuple:
    rng = np.random.default_rng(settings.seed)
    d, n_filters, widths = settings.dimensions, settings.filters, settings.widths
    columns = sum(widths) * n_filters
    embedding = rng.normal(0, 0.3, (n_rows, d)).astype(np.float32)
    embedding[0] = 0
    squares = np.full((n_rows, 1), 1e-3, dtype=np.float32)  # Adagrad, a rate for each word
    kernel = _Adam(rng.normal(0, 0.3, (d, columns)).astype(np.float32), settings.rate / 2)
    bias = _Adam(np.zeros(len(widths) * n_filters, dtype=np.float32), settings.rate / 2)
    dense = _Adam(rng.normal(0, 0.3, len(widths) * n_filters).astype(np.float32), settings.rate / 2)
    offset = _Adam(np.zeros(1, dtype=np.float32), settings.rate / 2)
    # for every column of the kernel: its filter, and its place in the window
    filter_of = np.concatenate([np.tile(np.arange(n_filters), w) + k * n_filters for k, w in enumerate(widths)])
    place_of = np.concatenate([np.repeat(np.arange(w), n_filters) for w in widths])
    batch = 16
    for _ in range(settings.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            g_kernel, g_bias, g_dense, g_offset = np.zeros_like(kernel.value), np.zeros_like(bias.value), np.zeros_like(dense.value), np.zeros(1, dtype=np.float32)
            touched, pulls = [], []
            for k in some:
                rows = texts[k].copy()
                rows[rng.random(len(rows)) < settings.hidden_words, 0] = 1
                seen, back = np.unique(np.concatenate([[0], rows.ravel()]), return_inverse=True)
                pooled, where = _pool(embedding[seen] @ kernel.value, back[1:].reshape(rows.shape), widths, n_filters)
                hidden = np.maximum(pooled + bias.value, 0.0)
                z = float(hidden @ dense.value) + float(offset.value[0])
                err = np.float32(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[k])
                g_dense += err * hidden
                g_offset += err
                g_hidden = np.where(hidden > 0, err * dense.value, 0.0).astype(np.float32)
                g_bias += g_hidden
                position = where[filter_of] + place_of
                row = np.zeros((len(position), rows.shape[1]), dtype=np.int64)
                row[position < len(rows)] = rows[position[position < len(rows)]]
                pull = g_hidden[filter_of]
                g_kernel += embedding[row].sum(axis=1).T * pull
                touched.append(row.ravel())
                pulls.append(np.repeat(kernel.value.T * pull[:, None], rows.shape[1], axis=0))
            n = len(some)
            rows, grads = np.concatenate(touched), np.concatenate(pulls) / n
            unique, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(unique), d), dtype=np.float32)
            np.add.at(total, back, grads)
            total[unique == 0] = 0
            squares[unique] += (total * total).mean(axis=1, keepdims=True)
            embedding[unique] -= 5 * settings.rate * total / np.sqrt(squares[unique])
            for part, grad in ((kernel, g_kernel), (bias, g_bias), (dense, g_dense), (offset, g_offset)):
                part.step((grad / n).astype(np.float32) + np.float32(settings.decay) * part.value)
    return embedding, kernel.value, bias.value, dense.value, float(offset.value[0])


def _best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Half-way in the widest of the best gaps: least weighted errors, then largest margin."""
    order = np.argsort(z)
    z, y, weight = z[order], y[order], weight[order]
    below = np.concatenate([[0.0], np.cumsum(weight * y)])  # toxic ones that would be missed
    above = (weight * (1 - y)).sum() - np.concatenate([[0.0], np.cumsum(weight * (1 - y))])  # clean ones that would be taken
    errors = below + above
    edges = np.concatenate([[z[0] - 2.0], z, [z[-1] + 2.0]])
    gaps = edges[1:] - edges[:-1]
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    k = best[gaps[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def fit_texts(texts: list[str], labels: list[int], toxic_share: float = 0.5, settings: Settings = Settings()) -> Model | None:
    """Train on labelled texts; a fifth of them is kept for the thresholds.

    ``toxic_share`` is the share of toxic rows where the sample comes from, as the sample is balanced.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y):
        return None
    overlap = max(settings.widths) - 1
    nothing = np.zeros((0, 1 + len(BEGINNINGS)), dtype=np.int64)
    slots = [np.concatenate([nothing, *(s[: len(s) - keep] for s, keep in _slot_parts(t, overlap))]) for t in texts]
    apart = np.arange(len(y)) % 5 == 0
    train = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
    frequency = np.zeros((1 + len(BEGINNINGS), 1 << SLOT_BITS), dtype=np.int32)
    for k in train:
        for column in range(1 + len(BEGINNINGS)):
            of = np.unique(slots[k][:, column])
            frequency[column, of[of >= 0]] += 1
    row_of_slot = np.ones(frequency.shape, dtype=np.int32)
    known = frequency >= settings.least_texts
    row_of_slot[known] = np.arange(known.sum()) + 2
    parts = _train([_rows(row_of_slot, s) for s in (slots[k] for k in train)], y[train], int(known.sum()) + 2, settings)
    embedding, kernel, bias, dense, offset = parts
    table = _language_table()
    model = Model(row_of_slot, (embedding @ kernel).astype(np.float32), bias, dense, offset, settings.widths, settings.filters, table, np.zeros(len(LANGUAGES)), 1.0)
    z, language = map(np.array, zip(*(logit(model, t) for t in texts)))
    # texts that were trained on count little: they look easier than they are
    weight = np.where(y == 1, toxic_share / max(y.mean(), 1e-9), (1 - toxic_share) / max(1 - y.mean(), 1e-9)) * np.where(apart, 1.0, 0.05)
    common = _best_threshold(z, y, weight)
    thresholds = np.full(len(LANGUAGES), common)
    for k in range(len(LANGUAGES)):
        of = language == k
        if (apart & of & (y == 1)).sum() >= 20 and (apart & of & (y == 0)).sum() >= 20:
            thresholds[k] = _best_threshold(z[of], y[of], weight[of])
    return Model(row_of_slot, model.products, bias, dense, offset, settings.widths, settings.filters, table, thresholds, 1.0)


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, which: int = 0, settings: Settings = Settings()) -> Model | None:
    """Learn from labelled rows outside the held-out fold: about ``settings.per_class`` texts of either label."""
    learn = is_learned(folds, which)
    texts, y = learning_texts(documents, labels, "toxic", learn, settings.per_class)
    share = labels.select(F.col("doc_id").alias("_id"), "toxic").filter(learn).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit_texts(texts, y, 0.5 if share is None else share, settings)


def toxicity(documents: DataFrame, model: Model | None, text: str = "text") -> Column:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda t: score(known, t)

    return per_text(make, pa.float64(), F.col(text))


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, which: int = 0, settings: Settings = Settings()) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    model = fit(documents, labels, folds, which, settings)
    rows = documents.select("doc_id", "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), toxicity(rows, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
