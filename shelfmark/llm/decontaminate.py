"""Benchmark decontamination by winnowing.

Words are runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII.  Of every
``WINDOW - GRAM + 1`` consecutive word-``GRAM`` hashes the smallest is kept, the right one of
equals, in documents and in benchmark items.  A span of ``WINDOW`` shared words holds the
same window of hashes on both sides, so both keep the same one: joining the kept
fingerprints misses no such span.  Every hit is then compared word by word and extended as
far as the words agree.  Items shorter than a window count as one window of their own length
and are looked up by that length.

The benchmark goes to the tasks in blocks of bounded size (``BLOCK_BYTES`` of text); with a
larger benchmark the documents are read once for each block, never shuffled by word.

Defined results: NULL or empty text has no words and is clean; an item without words never
occurs; an item without item_id counts in ``n_hit`` but not in ``n_items``; repeated rows
each get their row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import free_name, per_text
from shelfmark.llm.words import STRETCH, hashes_of, mixed, plain, stretches, word_hashes

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 8 << 20

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", SPANS)])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = h * _STEP + words[k : len(words) - n + 1 + k]
    return mixed(h)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash, the right one of equals, of every ``width`` consecutive ones."""
    if len(hashes) < width:
        return np.empty(0, dtype=np.int64)
    n = len(hashes) - width + 1
    least, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, width):
        h = hashes[k : k + n]
        lower = h <= least
        least = np.where(lower, h, least)
        at = np.where(lower, np.arange(k, k + n), at)
    return np.unique(at)


class Benchmark:
    """Fingerprints of some benchmark items, ready for look-up."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids: list[str | None] = []
        self.words: list[list[bytes]] = []
        kept, short = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = plain(text or "").split()
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            hashes = hashes_of(words)
            if len(words) < window:
                short[len(words)][int(gram_hashes(hashes, len(words))[0])].append(k)
                continue
            grams = gram_hashes(hashes, gram)
            for at in winnow(grams, window - gram + 1):
                kept[int(grams[at])].append((k, int(at)))
        self.kept, self.short = dict(kept), {n: dict(x) for n, x in short.items()}
        self.sorted = np.array(sorted(kept), dtype=np.uint64)
        self.short_sorted = {n: np.array(sorted(x), dtype=np.uint64) for n, x in short.items()}

    def look_up(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words of a stretch are hit, and by which items."""
        hit, items = np.zeros(len(starts), dtype=bool), set()
        hashes = word_hashes(data, starts, ends)
        grams = gram_hashes(hashes, self.gram)
        if len(self.sorted) and len(starts) >= self.window:
            at = winnow(grams, self.window - self.gram + 1)
            at = at[_is_in(grams[at], self.sorted)]
            done: dict[tuple[int, int], int] = {}
            for i in at.tolist():
                for k, j in self.kept[int(grams[i])]:
                    if done.get((k, i - j), -1) > i:
                        continue
                    a, b = self._extend(data, starts, ends, i, self.words[k], j)
                    done[k, i - j] = b
                    if b - a >= self.window:
                        hit[a:b] = True
                        items.add(k)
        for n, known in self.short_sorted.items():
            grams = gram_hashes(hashes, n)
            for i in np.flatnonzero(_is_in(grams, known)).tolist():
                for k in self.short[n][int(grams[i])]:
                    if all(data[starts[i + m] : ends[i + m]] == w for m, w in enumerate(self.words[k])):
                        hit[i : i + n] = True
                        items.add(k)
        return hit, items

    def _extend(self, data: bytes, starts: np.ndarray, ends: np.ndarray, i: int, words: list[bytes], j: int) -> tuple[int, int]:
        """The longest run of equal words around words ``i`` and ``j``: where it begins and ends in the text."""
        a, b, shift = i, i, j - i
        while b < len(starts) and b + shift < len(words) and data[starts[b] : ends[b]] == words[b + shift]:
            b += 1
        while a > 0 and a + shift > 0 and data[starts[a - 1] : ends[a - 1]] == words[a - 1 + shift]:
            a -= 1
        return a, b

    def search(self, text: str | None, stretch: int = STRETCH) -> dict:
        """n_words, items and hit spans (word numbers, end exclusive) of a whole text."""
        data = plain(text) if text else b""
        flags, base = np.zeros(0, dtype=bool), 0
        spans: list[list[int]] = []
        items: set[int] = set()

        def close(hit: np.ndarray, first: int) -> None:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
            for a, b in zip((edges[0::2] + first).tolist(), (edges[1::2] + first).tolist()):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])

        for part, starts, ends, keep in stretches(data, self.window - 1, stretch):
            hit, found = self.look_up(part, starts, ends)
            hit[: len(flags)] |= flags
            items |= found
            # windows over the border lie in the next stretch, which begins with these words
            close(hit[: len(hit) - keep], base)
            base += len(hit) - keep
            flags = hit[len(hit) - keep :]
        names = sorted({self.ids[k] for k in items if self.ids[k] is not None})
        return {"n_words": base, "items": names, "spans": [{"start": a, "end": b} for a, b in spans]}


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        of = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield [(r["item"], r["text"]) for r in of.orderBy("item", "text").collect()]


def hit_words(spans: Column) -> Column:
    """How many words lie in spans that may overlap."""
    def add(state, span):
        first = F.greatest(state["upto"], span["start"])
        return F.struct(F.greatest(state["upto"], span["end"]).alias("upto"), (state["n"] + F.greatest(span["end"] - first, F.lit(0))).alias("n"))

    empty = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), empty, add, lambda s: s["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of the benchmark each document holds: doc_id, n_words, n_hit, n_items, items, spans."""
    context = documents.sparkSession.sparkContext
    shared = [context.broadcast(Benchmark(items)) for items in benchmark_blocks(benchmark, block_bytes)] or [context.broadcast(Benchmark([]))]
    rows = documents.select("doc_id", "text")
    passes = [rows.select("doc_id", "text", per_text(lambda b=b: b.value.search, FOUND, F.col("text")).alias("_found")) for b in shared]
    if len(passes) == 1:
        found = passes[0].select("doc_id", "_found.*")
    else:
        every = passes[0]
        for other in passes[1:]:
            every = every.unionAll(other)
        # rows of the same id and text are alike; they count once each
        found = (
            every.select("doc_id", F.sha2("text", 256).alias("_digest"), "_found.*")
            .groupBy("doc_id", "_digest")
            .agg(
                F.max("n_words").alias("n_words"),
                F.array_distinct(F.flatten(F.collect_list(F.when(F.size("items") > 0, F.col("items"))))).alias("items"),
                F.array_distinct(F.flatten(F.collect_list(F.when(F.size("spans") > 0, F.col("spans"))))).alias("spans"),
                (F.count("*") / len(passes)).cast("int").alias("_rows"),
            )
            .withColumn("_row", F.explode(F.expr("sequence(1, _rows)")))
        )
    return found.select("doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), "spans")


def clean(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any word hit, all their columns kept."""
    context, rows = documents.sparkSession.sparkContext, documents
    for items in benchmark_blocks(benchmark, block_bytes):
        shared = context.broadcast(Benchmark(items))
        hit = per_text(lambda b=shared: lambda text: bool(b.value.search(text)["spans"]), pa.bool_(), F.col("text"))
        name = free_name(rows, "_hit")
        rows = rows.withColumn(name, hit).filter(~F.col(name)).drop(name)
    return rows


ORACLE_SQL = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p + 1, p + least(len(w), 10)), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS p FROM items WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p + 1, p + n), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS p
        FROM lower_docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT g.doc_id, g.p, g.n, i.item_id FROM grams g JOIN windows i USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""
