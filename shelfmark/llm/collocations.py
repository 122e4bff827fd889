"""Phrase collocations, counted in HAT-tries.

A task counts phrases in a HAT-trie: a shallow trie over word ids (64-bit hashes), whose leaves
are hash containers of the remaining ids that burst into a trie node when they grow.  When the
trie holds ``most_entries``, its largest subtrees are spilled whole, as sorted runs, until it is
half empty.  Runs are dealt by their prefix (language and first word) and merged there; texts of
phrases are put together at the end, for the frequent ones alone.

Phrases are counted by length.  A phrase can only be frequent if the two phrases that lack its
last or first word are, so each length passes by what a bitmap of the frequent phrases before it
rules out.  The bitmap has a bounded size, never rules out a frequent phrase, and decides only
how much is counted; what is kept is decided by exact counts.

Scores are integers: floor(1000 * a * n / (l * r)) in 38-digit decimals.

Defined results: NULL text has no words, a NULL lang is ``und``; repeated rows count as often as
they are; texts of any length are read in stretches that overlap by a phrase; an empty table, or
one without frequent phrases, gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.bitmaps import HashedSet, hashed_set
from shelfmark.llm.decontaminate import _STEP, gram_hashes
from shelfmark.llm.words import hashes_of, mixed, stretches, word_hashes
from shelfmark.session import stage

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_BREAK = hashes_of([b"\n"])[0]
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    longest: int = 5
    least: int = 100  # occurrences of a phrase
    share: int = 100  # percent of a phrase's occurrences that a longer one must reach to stand for it
    top: int = 2000  # of each language
    most_entries: int = 600_000  # in a task's trie
    burst: int = 4_096  # entries of a container
    stretch: int = 1 << 20  # bytes of text that are counted together


class Node(dict):
    """A trie node: next id -> node or container.  Containers are plain dicts: rest of the key -> count."""


class HatTrie:
    """Counts of keys of a fixed number of eight-byte ids, each under a prefix of its own.

    The root leads from prefixes to containers; one that grows beyond ``burst`` becomes a node by
    the next id, as long as its keys have more than one.
    """

    ID = 8

    def __init__(self, burst: int):
        self.burst, self.entries = burst, 0
        self.root = Node()

    def add(self, prefix: bytes, keys: list[bytes], counts: list[int]) -> None:
        """Add the keys of one prefix."""
        here = self.root.get(prefix)
        if here is None:
            here = self.root[prefix] = {}
        if type(here) is Node:
            for key, count in zip(keys, counts):
                child = here.get(key[: self.ID])
                if child is None:
                    child = here[key[: self.ID]] = {}
                rest = key[self.ID :]
                was = child.get(rest, 0)
                self.entries += not was
                child[rest] = was + count
            return
        before, get = len(here), here.get
        for key, count in zip(keys, counts):
            here[key] = get(key, 0) + count
        self.entries += len(here) - before
        if len(here) > self.burst and len(keys[0]) > self.ID:
            node = self.root[prefix] = Node()
            for key, count in here.items():
                node.setdefault(key[: self.ID], {})[key[self.ID :]] = count

    def _run(self, tree: dict) -> tuple[list[bytes], list[int]]:
        if type(tree) is not Node:
            keys = sorted(tree)
            return keys, [tree[k] for k in keys]
        keys, counts = [], []
        for edge in sorted(tree):
            rest, more = self._run(tree[edge])
            keys += [edge + r for r in rest]
            counts += more
        return keys, counts

    def spill(self, leave: int = 0) -> Iterator[tuple[bytes, list[bytes], list[int]]]:
        """Whole subtrees as sorted runs (prefix, keys, counts), the largest first, until at most ``leave`` entries are left."""
        sizes = [(sum(map(len, tree.values())) if type(tree) is Node else len(tree), prefix) for prefix, tree in self.root.items()]
        for size, prefix in sorted(sizes, key=lambda s: (-s[0], s[1])):
            if self.entries <= leave:
                break
            yield prefix, *self._run(self.root.pop(prefix))
            self.entries -= size


def plain(text: str) -> bytes:
    """A-Z lower-cased, words parted by spaces; a line end stands for every sign that ends a piece, as a word of its own."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).replace(b"\n", b" \n ")


def _ids(keys: pa.Array, n: int) -> np.ndarray:
    """The word ids of binary keys, a row for each."""
    return np.frombuffer(b"".join(keys.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, n)


def _hashes_of_rows(ids: np.ndarray) -> np.ndarray:
    """The hash by which a phrase is looked up in a bitmap."""
    h = np.zeros(len(ids), dtype=np.uint64)
    for k in range(ids.shape[1]):
        h = h * _STEP + ids[:, k]
    return mixed(h)


class Counter:
    """Counts the phrases of ``n`` words of one task."""

    def __init__(self, n: int, known: HashedSet, settings: Settings):
        self.n, self.known, self.settings = n, known, settings
        self.trie = HatTrie(settings.burst)
        self.langs: dict[bytes, str] = {}

    def take(self, lang: str, data: bytes) -> None:
        lang_id = hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=HatTrie.ID).digest()
        self.langs[lang_id] = lang
        n, add = self.n, self.trie.add
        for part, starts, ends, keep in stretches(data, n - 1, self.settings.stretch):
            hashes = word_hashes(part, starts, ends)
            m = len(hashes) - n + 1
            if m <= 0:
                continue
            inside = hashes != _BREAK
            shorter = self.known.has(gram_hashes(hashes, n - 1))
            alive = shorter[:m] & shorter[1 : m + 1]
            for k in range(n):
                alive &= inside[k : k + m]
            # windows that begin in the words carried over are counted with the next part
            alive[len(hashes) - keep :] = False
            at = np.flatnonzero(alive)
            if not len(at):
                continue
            ids = np.stack([hashes[at + k] for k in range(n)], axis=1)
            ids = ids[np.lexsort(ids.T[::-1])]
            new = np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(ids))).tolist()
            ids = ids[first]
            raw, width = np.ascontiguousarray(ids[:, 1:].astype(">u8")).tobytes(), 8 * (n - 1)
            keys = [raw[k : k + width] for k in range(0, len(raw), width)]
            edges = np.append(np.flatnonzero(np.concatenate([[True], ids[1:, 0] != ids[:-1, 0]])), len(ids)).tolist()
            heads = ids[edges[:-1], 0].astype(">u8").tobytes()
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                add(lang_id + heads[8 * k : 8 * k + 8], keys[a:b], counts[a:b])

    def _rows(self, runs: Iterator[tuple[bytes, list[bytes], list[int]]]) -> Iterator[pa.RecordBatch]:
        """Sorted runs as (lang, first, keys, counts), a row for each subtree."""
        rows: list[tuple] = []
        for prefix, keys, counts in runs:
            rows.append((self.langs[prefix[:8]], int.from_bytes(prefix[8:], "big", signed=True), b"".join(keys), np.array(counts, dtype=np.int64).astype(np.uint32 if max(counts) < 1 << 32 else np.int64).tobytes()))
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.trie.entries > self.settings.most_entries:
            yield from self._rows(self.trie.spill(self.settings.most_entries // 2))

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._rows(self.trie.spill())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["lang", "first", "keys", "counts"])


class Merger:
    """Sums the runs of one prefix; what it holds is never much more than the distinct keys."""

    def __init__(self, n: int):
        self.n, self.ids, self.counts, self.waiting = n, [], [], 0

    def add(self, keys: bytes, counts: bytes) -> None:
        ids = np.frombuffer(keys, dtype=">u8").astype(np.uint64).reshape(-1, self.n - 1)
        self.ids.append(ids)
        self.counts.append(np.frombuffer(counts, dtype=np.uint32 if len(counts) == 4 * len(ids) else np.int64).astype(np.int64))
        self.waiting += len(ids)
        if self.waiting > 2 * len(self.ids[0]) + (1 << 20):
            self.ids, self.counts = ([x] for x in self.merged())
            self.waiting = len(self.ids[0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.concatenate(self.ids), np.concatenate(self.counts)
        if len(self.ids) > 1:
            order = np.lexsort(ids.T[::-1])
            ids = ids[order]
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
            ids, counts = ids[first], np.add.reduceat(counts[order], first)
        return ids, counts


def _word_ids(words: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names = [w.encode("utf-8", "surrogatepass") for w in batch.to_pylist()]
            raw = hashes_of(names).astype(">u8").tobytes()
            yield pa.array([raw[k : k + 8] for k in range(0, len(raw), 8)], pa.binary())

    return F.arrow_udf(run, "binary")(words)


def frequent_words(documents: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(lang, word, key, f) of frequent words, and (lang, n) of all word occurrences."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(lower, r"[ \t.,;:!?\n\x0B\f\r]+")).alias("word"))
    counted = stage(words.filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f")), "words")
    frequent = counted.filter(F.col("f") >= settings.least).withColumn("key", _word_ids(F.col("word")))
    return stage(frequent, "frequent-words"), counted.groupBy("lang").agg(F.sum("f").alias("n"))


def frequent_phrases(documents: DataFrame, shorter: DataFrame, n: int, settings: Settings = Settings()) -> DataFrame:
    """(lang, key, f) of the frequent phrases of ``n`` words; ``shorter`` are those with a word less."""

    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(_hashes_of_rows(_ids(batch, n - 1)).view(np.int64))

    known = hashed_set(shorter, F.arrow_udf(hashes, "long")("key"), shorter.count())
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, waiting, size = Counter(n, shared.value, settings), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                data = plain(text.as_py())
                waiting.setdefault(lang.as_py(), []).append(data)
                size += len(data)
                if size >= settings.stretch:
                    for name, parts in waiting.items():
                        counter.take(name, b" \n ".join(parts))
                    waiting, size = {}, 0
                    yield from counter.full()
        for name, parts in waiting.items():
            counter.take(name, b" \n ".join(parts))
        yield from counter.full()
        yield from counter.rest()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merger = None, None

        def done() -> Iterator[pa.RecordBatch]:
            ids, counts = merger.merged()
            kept = np.flatnonzero(counts >= settings.least)
            if len(kept):
                head = now[1].to_bytes(8, "big", signed=True)
                keys = [head + row.tobytes() for row in ids[kept].astype(">u8")]
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(kept)), pa.array(keys, pa.binary()), pa.array(counts[kept])], ["lang", "key", "f"])

        for batch in batches:
            for lang, first, keys, counts in zip(*batch.columns):
                prefix = lang.as_py(), first.as_py()
                if prefix != now:
                    if merger:
                        yield from done()
                    now, merger = prefix, Merger(n)
                merger.add(keys.as_py(), counts.as_py())
        if merger:
            yield from done()

    texts = documents.filter("text IS NOT NULL").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    runs = texts.mapInArrow(count, "lang string, first long, keys binary, counts binary")
    dealt = runs.repartition("lang", "first").sortWithinPartitions("lang", "first")
    return stage(dealt.mapInArrow(merge, "lang string, key binary, f long"), f"phrases-{n}")


def with_text(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, f): the words of every key, from the table of frequent words."""
    places = F.sequence(F.lit(0), F.expr("length(key) div 8 - 1"))
    each = phrases.select("lang", "key", "f", F.posexplode(F.transform(places, lambda k: F.substring(F.col("key"), k * 8 + 1, F.lit(8)))).alias("place", "id"))
    named = each.join(words.select("lang", F.col("key").alias("id"), "word"), ["lang", "id"])
    put = named.groupBy("lang", "key", "f").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    return put.select("lang", F.concat_ws(" ", F.col("words.word")).alias("phrase"), "f")


def _sub_phrases(words: Column, shortest: int, longest: int) -> Column:
    """All contiguous parts of a list of words, of the given lengths, as phrases."""
    def parts(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda at: F.concat_ws(" ", F.slice(words, at, F.lit(k))))

    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.size(words) > k, parts(k)).otherwise(none) for k in range(shortest, longest + 1)])


def collocations(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    documents = documents.select("text", "lang")
    singles, totals = frequent_words(documents, settings)
    levels = [singles]
    for n in range(2, settings.longest + 1):
        levels.append(frequent_phrases(documents, levels[-1], n, settings))
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.unionAll(level)
    candidates = stage(with_text(candidates, singles), "candidates")
    counts = singles.select("lang", F.col("word").alias("phrase"), "f").unionAll(candidates)
    words = F.split("phrase", " ")
    known = candidates.withColumn("words", words)

    # phrases that a longer one stands for
    inside = known.filter(F.size("words") > 2).select("lang", "f", F.explode(_sub_phrases(F.col("words"), 2, settings.longest - 1)).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = known.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {settings.share} * f")).drop("longer")

    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))), "rest": F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.size("words")))})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = {c: f"CAST({c} AS DECIMAL(20, 0))" for c in "alrn"}
    score = F.expr(f"CAST({exact['a']} * 1000 * {exact['n']} AS DECIMAL(38, 0)) div CAST({exact['l']} * {exact['r']} AS DECIMAL(38, 0))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("cut"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= settings.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_no, unnest(p) AS piece, generate_subscripts(p, 1) AS piece_no
  FROM (SELECT lang, row_number() OVER () AS doc_no,
          string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
inside AS (
  SELECT lang, array_to_string(list_slice(w, p, p + part - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, part, unnest(range(1, size - part + 2)) AS p FROM candidates, (SELECT unnest(range(2, 5)) AS part) WHERE part < size)
  GROUP BY ALL),
free AS (SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, size), ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS cut FROM free)),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.cut, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
