"""Quality: a generalised additive model with pairwise interactions.

Each text becomes a row of plain measures, each measure falls into a bin.  Shallow trees,
boosted over the measures in turn, add up to a look-up table for each measure; then tables
for the pairs of measures that explain most of what is left.  A score is a sum of table
entries, passed through the logistic function, so it can be read off.

Defined results: NULL and empty text is measured as a text without characters and scored
like any other; repeated rows are scored alike; without labelled rows every score is 0.
Columns other than ``text`` are never looked at when scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import held_out, is_learned, learning_texts, per_slice
from shelfmark.llm.words import mixed, plain, stretches, word_hashes

MEASURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper_share", "digit_share", "mark_share", "symbol_share", "commonest_symbol",
    "space_share", "line_share", "words_a_line", "distinct_words", "commonest_word", "repeated_next", "repeated_grams", "repeated_lines",
    "stops_a_word", "commas_a_word", "exclaims_a_word", "byte_entropy", "beyond_ascii", "symbols_a_word",
)
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*b".,;:!?'\"()-"]] = True
_SYMBOLS = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)]) & ~_MARKS
_GRAM = 5


@dataclass(frozen=True)
class Settings:
    per_class: int = 2500  # the bound of the learning sample, for each label
    bins: int = 32
    rounds: int = 150
    rate: float = 0.1
    leaves: int = 3
    pairs: int = 6
    pair_bins: int = 8
    pair_rounds: int = 60
    smoothing: float = 5.0


@dataclass(frozen=True)
class Model:
    cuts: tuple[np.ndarray, ...]  # of each measure
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_cuts: tuple[np.ndarray, ...]
    pair_tables: tuple[np.ndarray, ...]
    intercept: float


def measure(text: str | None) -> list[float]:
    """The measures of a whole text, in the order of ``MEASURES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    hashes, longest = [np.zeros(0, dtype=np.uint64)], 0
    for part, starts, ends, keep in stretches(plain(text or ""), 0):
        hashes.append(word_hashes(part, starts, ends))
        longest = max(longest, int((ends - starts).max(initial=0)))
    words = np.concatenate(hashes)
    n, n_words = max(1, len(data)), max(1, len(words))
    unique, times = np.unique(words, return_counts=True)
    letters = counts[65:91].sum() + counts[97:123].sum()
    grams = len(words) - _GRAM + 1
    repeated = 0.0
    if grams > 0:
        h = np.zeros(grams, dtype=np.uint64)
        for k in range(_GRAM):
            h = mixed(h + words[k : k + grams])
        repeated = 1 - len(np.unique(h)) / grams
    lines = data.split(b"\n")
    share = counts[counts > 0] / n
    symbols = counts[_SYMBOLS]
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        (counts[48:58].sum() + letters + counts[128:].sum()) / n_words,
        np.log1p(longest),
        counts[65:91].sum() / max(1, letters),
        counts[48:58].sum() / n,
        counts[_MARKS].sum() / n,
        symbols.sum() / n,
        symbols.max() / n,
        counts[32] / n,
        counts[10] / n,
        np.log1p(len(words) / len(lines)),
        len(unique) / n_words,
        times.max(initial=0) / n_words,
        (words[1:] == words[:-1]).sum() / n_words,
        repeated,
        1 - len(set(lines)) / len(lines),
        counts[46] / n_words,
        counts[44] / n_words,
        counts[33] / n_words,
        -float((share * np.log2(share)).sum()),
        counts[128:].sum() / n,
        symbols.sum() / n_words,
    ]


def _bins(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, values, side="right")


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, smoothing: float) -> np.ndarray:
    """A shallow tree over ordered bins: best-first splits, a Newton step in every leaf."""
    total_g, total_h = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = total_g[a + 1 : b] - total_g[a], total_h[a + 1 : b] - total_h[a]
        all_g, all_h = total_g[b] - total_g[a], total_h[b] - total_h[a]
        gains = left_g**2 / (left_h + smoothing) + (all_g - left_g) ** 2 / (all_h - left_h + smoothing) - all_g**2 / (all_h + smoothing)
        return float(gains.max()), a + 1 + int(gains.argmax())

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = max(((*gain(a, b), a, b) for a, b in parts), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, cut, a, b = best
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + smoothing)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, smoothing: float) -> tuple[np.ndarray, float]:
    """The best cut of each axis makes four leaves over the bins of a pair; with its gain."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def four(x: np.ndarray) -> np.ndarray:
        inner, right, down = x[1:-1, 1:-1], x[1:-1, -1:], x[-1:, 1:-1]
        return np.stack([inner, right - inner, down - inner, x[-1, -1] - right - down + inner])

    if gradient.shape[0] < 2 or gradient.shape[1] < 2:
        return np.zeros_like(gradient), 0.0
    quarter_g, quarter_h = four(g), four(h)
    gains = (quarter_g**2 / (quarter_h + smoothing)).sum(axis=0)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    step = quarter_g[:, i, j] / (quarter_h[:, i, j] + smoothing)
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return out, float(gains[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + smoothing))


def fit_rows(x: np.ndarray, y: np.ndarray, good_share: float = 0.5, settings: Settings = Settings()) -> Model:
    """Boost the tables on measured rows; ``good_share`` is the share of label 1 where the balanced sample comes from."""
    n = len(y)
    cuts = tuple(_quantile_cuts(x[:, k], settings.bins) for k in range(x.shape[1]))
    binned = [_bins(x[:, k], c) for k, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    weight = np.where(y == 1, good_share / max(y.mean(), 1e-9), (1 - good_share) / max(1 - y.mean(), 1e-9))
    good = float(np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99))
    intercept = np.log(good / (1 - good))
    z = np.full(n, intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(settings.rounds):
        for k, b in enumerate(binned):
            g, h = slopes()
            step = settings.rate * _tree(np.bincount(b, g, len(tables[k])), np.bincount(b, h, len(tables[k])), settings.leaves, settings.smoothing)
            tables[k] += step
            z += step[b]
    pair_cuts = tuple(_quantile_cuts(x[:, k], settings.pair_bins) for k in range(x.shape[1]))
    coarse = [_bins(x[:, k], c) for k, c in enumerate(pair_cuts)]

    def sums(a: int, b: int, v: np.ndarray) -> np.ndarray:
        rows, columns = len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1
        return np.bincount(coarse[a] * columns + coarse[b], v, rows * columns).reshape(rows, columns)

    g, h = slopes()
    every = [(a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    pairs = sorted(every, key=lambda ab: -_pair_tree(sums(*ab, g), sums(*ab, h), settings.smoothing)[1])[: settings.pairs]
    pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in pairs]
    for _ in range(settings.pair_rounds):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = settings.rate * _pair_tree(sums(a, b, g), sums(a, b, h), settings.smoothing)[0]
            pair_tables[k] += step
            z += step[coarse[a], coarse[b]]
    return Model(cuts, tuple(tables), tuple(pairs), pair_cuts, tuple(pair_tables), float(intercept))


def score_rows(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores of measured rows: one addition for each table."""
    z = np.full(len(x), model.intercept)
    for k, (cuts, table) in enumerate(zip(model.cuts, model.tables)):
        z += table[_bins(x[:, k], cuts)]
    for (a, b), table in zip(model.pairs, model.pair_tables):
        z += table[_bins(x[:, a], model.pair_cuts[a]), _bins(x[:, b], model.pair_cuts[b])]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, which: int = 0, settings: Settings = Settings()) -> Model | None:
    """Learn from labelled rows outside the held-out fold: about ``settings.per_class`` texts of either label."""
    learn = is_learned(folds, which)
    texts, y = learning_texts(documents, labels, "quality", learn, settings.per_class)
    if not texts:
        return None
    share = labels.select(F.col("doc_id").alias("_id"), "quality").filter(learn).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit_rows(np.array([measure(t) for t in texts]), np.array(y, dtype=float), 0.5 if share is None else share, settings)


def quality(documents: DataFrame, model: Model | None, text: str = "text") -> Column:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        return lambda texts: np.zeros(len(texts)) if known is None else score_rows(known, np.array([measure(t) for t in texts]))

    return per_slice(make, pa.float64(), F.col(text))


def classify(documents: DataFrame, labels: DataFrame, folds: int = 5, which: int = 0, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    model = fit(documents, labels, folds, which, settings)
    rows = documents.select("doc_id", "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), quality(rows, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
