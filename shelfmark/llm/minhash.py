"""Near duplicates by circulant MinHash.

A document is the set of its distinct word shingles.  One permutation of the 32-bit hash
universe scatters a set; a second one, shifted by one place for every coordinate, gives all
coordinates of its signature as minima.  Bands of coordinates name buckets, and what shares a
bucket is a candidate; links are confirmed on whole sets by exact Jaccard similarity.

Equal sets are one node.  Candidates are never expanded into all pairs of a bucket:

1. every node is compared with the first node of each of its buckets, and confirmed links are
   joined to components;
2. only buckets that then still hold several components are looked at again.  Their nodes are
   laid in tiles of bounded size; two tiles are compared by signatures within a task, which
   names the nodes that have a likely partner in another component;
3. the whole sets of those are compared in tiles, and each pair of tiles gives a spanning forest
   of the components that it links.

So a group of thousands of near copies costs one comparison for each, and only what is left
over is compared with the rest, by numpy, in tiles.

With 30 bands of 5 coordinates a pair of similarity 0.85 shares no bucket with a probability of
2e-8.  Pairs of clearly lower similarity by 150 coordinates (six standard deviations) are not
confirmed.

Defined results: NULL or empty text, or white space alone, is an empty set and linked with nothing;
fewer words than a shingle are one shingle; repeated rows each get their row; a row without
doc_id belongs to its component, and has itself none if all of it lack one; ``kept`` is false then.
Words are compared by 64-bit hashes, sets by 128-bit ones.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from shelfmark.llm.common import per_slice, per_text
from shelfmark.llm.components import connected_components
from shelfmark.llm.decontaminate import gram_hashes
from shelfmark.llm.words import STRETCH, mixed, stretches, word_hashes
from shelfmark.operators.skew import busy_keys, lookup_join
from shelfmark.session import stage

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_STEP = np.uint64(0xD6E8FEB86659FD93)
FEATURES = pa.struct([("node", pa.string()), ("n", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    percent: int = 85  # of the union that two sets have to share
    bands: int = 30
    rows: int = 5
    doubts: float = 6.0  # standard deviations by which an estimate may fall short
    tile: int = 1024  # nodes in a tile whose signatures are compared, on average at most
    tile_shingles: int = 200_000  # shingles in a tile whose sets are compared, likewise
    seed: int = 42

    @property
    def width(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal coordinates below which a pair is not looked at."""
        j = self.percent / 100
        return int(np.floor(self.width * j - self.doubts * np.sqrt(self.width * j * (1 - j))))


def shingles(text: str | None, size: int, stretch: int = STRETCH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER) if text else b""
    found, n_words, few = [], 0, np.empty(0, dtype=np.uint64)
    for part, starts, ends, keep in stretches(data, size - 1, stretch):
        hashes = word_hashes(part, starts, ends)
        n_words += len(starts) - keep
        few = hashes
        found.append(np.unique(gram_hashes(hashes, size)))
    if 0 < n_words < size:
        return gram_hashes(few, n_words)
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def _permuted(x: np.ndarray, mask: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= np.uint32(mask)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], settings: Settings = Settings()) -> np.ndarray:
    """The signature of every set; an empty one has the largest value everywhere."""
    out = np.full((len(sets), settings.width), 0xFFFFFFFF, dtype=np.uint32)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return out
    first, second = np.random.default_rng(settings.seed).integers(0, 1 << 32, 2, dtype=np.uint64).tolist()
    starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])[:-1]])
    scattered = _permuted((np.concatenate([sets[k] for k in some]) >> np.uint64(32)).astype(np.uint32), first)
    for c in range(settings.width):
        # the second permutation, shifted by c places
        out[some, c] = np.minimum.reduceat(_permuted(scattered + np.uint32(c), second), starts)
    return out


def _bands(signature: np.ndarray, settings: Settings) -> np.ndarray:
    keys = np.tile(np.arange(1, settings.bands + 1, dtype=np.uint64) * _STEP, (len(signature), 1))
    cells = signature.reshape(len(signature), settings.bands, settings.rows)
    for r in range(settings.rows):
        keys = mixed(keys * _STEP + cells[:, :, r])
    return keys.view(np.int64)


def features(documents: DataFrame, settings: Settings = Settings()) -> Column:
    """node (a hash of the whole set), n, signature (the low byte of each coordinate) and bands of every text."""

    def make():
        def of(texts: list[str | None]) -> list[dict]:
            sets = [shingles(t, settings.shingle) for t in texts]
            signature = signatures(sets, settings)
            low, bands = (signature & np.uint32(255)).astype(np.uint8), _bands(signature, settings)
            return [
                {"node": hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), "n": len(s), "signature": low[k].tobytes() if len(s) else None, "bands": bands[k] if len(s) else None}
                for k, s in enumerate(sets)
            ]

        return of

    return per_slice(make, FEATURES, F.col("text"))


def _equal_coordinates(a: Column, b: Column) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            n = len(one)
            left, right = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint8).reshape(n, -1) for x in (one, two))
            yield pa.array((left == right).sum(axis=1) if n else [], pa.int32())

    return F.arrow_udf(run, "int")(a, b)


def _may_link(a: str, b: str, settings: Settings) -> Column:
    """Whether the sizes of two sets allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * settings.percent


def sets_of(documents: DataFrame, nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(node, hashes) of some nodes, given with ``first``, the smallest doc_id that has the set.

    The texts of those documents are found by id; the narrow side is hashed, so that texts are
    shuffled but not sorted, at every size.
    """
    ids = nodes.select(F.col("first").alias("doc_id")).distinct().hint("shuffle_hash")
    texts = documents.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text").unionAll(documents.filter("doc_id IS NULL").select("text"))
    kind = pa.struct([("node", pa.string()), ("hashes", pa.list_(pa.int64()))])

    def make():
        def of(text: str | None) -> dict:
            found = shingles(text, settings.shingle)
            return {"node": hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest(), "hashes": found.view(np.int64)}

        return of

    found = texts.select(per_text(make, kind, F.col("text")).alias("_set")).select("_set.node", "_set.hashes")
    # an id may repeat with other texts, or with the same
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes whose whole sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_one"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_two"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("_one", "_two"))
    union = F.size("_one") + F.size("_two") - common
    return both.filter(common.cast("long") * 100 >= union.cast("long") * settings.percent).select("a", "b")


def tile_pairs(rows: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """(key, same, one, two): the rows of each ``key`` in tiles, every tile with itself and those after it.

    ``blocks`` is an aggregate that says how many tiles a key needs.
    """
    sizes = rows.groupBy("key").agg(blocks.cast("int").alias("_blocks"))
    laid = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    laid = stage(laid.groupBy("key", "block").agg(F.collect_list(F.struct(*columns)).alias("members"), F.first("_blocks").alias("_blocks")), "tiles")
    left = laid.select("key", F.col("block").alias("_a"), F.col("members").alias("one"), F.explode(F.sequence(F.col("block"), F.col("_blocks") - 1)).alias("block"))
    right = laid.select("key", "block", F.col("members").alias("two"))
    return left.join(right, ["key", "block"]).select("key", (F.col("_a") == F.col("block")).alias("same"), "one", "two")


def _members(batch: pa.RecordBatch, name: str, k: int) -> dict[str, pa.Array]:
    members = batch.column(name)[k].values
    return {f.name: members.field(i) for i, f in enumerate(members.type)}


def likely_partners(a: np.ndarray, b: np.ndarray, band: int, apart: np.ndarray, settings: Settings, chunk: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two signature tables have a likely partner in the other that is allowed by ``apart``.

    A pair that shares an earlier band as well is looked at there.
    """
    hit_a, hit_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    upto = band * settings.rows
    for at in range(0, len(a), chunk):
        equal = a[at : at + chunk, None, :] == b[None, :, :]
        near = apart[at : at + chunk] & (equal.sum(axis=2, dtype=np.int16) >= settings.least_equal)
        rows, columns = np.nonzero(near)
        if len(rows):
            earlier = equal[rows, columns, :upto].reshape(len(rows), band, settings.rows).all(axis=2).any(axis=1)
            hit_a[at + rows[~earlier]] = True
            hit_b[columns[~earlier]] = True
    return hit_a, hit_b


def _with_partners(tiles: DataFrame, settings: Settings) -> DataFrame:
    """(key, node) of nodes that have a likely partner of another component in the same bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                key, same = batch.column("key")[k].as_py(), batch.column("same")[k].as_py()
                one = _members(batch, "one", k)
                two = one if same else _members(batch, "two", k)
                sides = []
                for side in (one, two):
                    n = len(side["node"])
                    signature = np.frombuffer(b"".join(side["signature"].to_pylist()), dtype=np.uint8).reshape(n, -1)
                    sides.append((signature, np.array(side["label"].to_pylist()), side["n"].to_numpy()))
                (sa, la, na), (sb, lb, nb) = sides
                apart = (la[:, None] != lb[None, :]) & (np.minimum(na[:, None], nb[None, :]) * 100 >= np.maximum(na[:, None], nb[None, :]) * settings.percent)
                band = one["band"][0].as_py()
                hit_a, hit_b = likely_partners(sa, sb, band, apart, settings)
                names = {x for side, hit in ((one, hit_a), (two, hit_b)) for x in side["node"].filter(pa.array(hit)).to_pylist()}
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(names), pa.int64()), pa.array(sorted(names))], ["key", "node"])

    return tiles.mapInArrow(run, "key long, node string").distinct()


def joined_labels(one: list[tuple[str, np.ndarray]], two: list[tuple[str, np.ndarray]], percent: int) -> list[tuple[str, str]]:
    """Pairs of labels that sets of two tiles link: a spanning forest, found with exact common counts."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    found = []
    universe, places = np.unique(np.concatenate([s for _, s in two]), return_inverse=True) if two else (np.empty(0, np.int64), np.empty(0, np.int64))
    sizes = np.array([len(s) for _, s in two])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if two else np.empty(0, np.int64)
    for label, mine in one:
        mark = np.zeros(len(universe), dtype=np.int64)
        known = np.intersect1d(mine, universe, assume_unique=True)
        mark[np.searchsorted(universe, known)] = 1
        common = np.add.reduceat(mark[places], starts) if len(starts) else np.empty(0, np.int64)
        for j in np.flatnonzero(common * 100 >= (len(mine) + sizes - common) * percent).tolist():
            x, y = find(label), find(two[j][0])
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((label, two[j][0]))
    return found


def _joined(tiles: DataFrame, settings: Settings) -> DataFrame:
    """Links (``a``, ``b``) between components, from whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                sides = []
                for name in ("one", "two"):
                    side = _members(batch, name, k)
                    sides.append([(label, hashes.values.to_numpy(zero_copy_only=False)) for label, hashes in zip(side["label"].to_pylist(), side["hashes"])])
                found = joined_labels(*sides, settings.percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["a", "b"])

    return tiles.mapInArrow(run, "a string, b string").distinct()


def _components(documents: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, label) of every node that is linked with another; ``nodes`` is staged."""
    buckets = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "n")
    shared = buckets.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("_members")).filter("_members > 1").select("key", "a")
    shared = stage(shared, "buckets")
    stars = buckets.select("key", F.col("node").alias("b")).join(shared, "key").filter("a <> b").select("a", "b").distinct()
    known = nodes.select("node", "n", "signature")
    stars = stars.join(known.toDF("a", "n_a", "s_a"), "a").join(known.toDF("b", "n_b", "s_b"), "b").filter(_may_link("n_a", "n_b", settings))
    stars = stars.filter(_equal_coordinates(F.col("s_a"), F.col("s_b")) >= settings.least_equal)
    stars = stage(stars.select("a", "b"), "stars")

    asked = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    sets = stage(sets_of(documents, nodes.select("node", "first").join(asked, "node", "left_semi"), settings), "sets")
    labels = connected_components(stage(confirmed(stars, sets, settings), "links"))

    # what shares a bucket and is still apart
    placed = buckets.join(shared.select("key"), "key", "left_semi").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed_buckets = placed.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select("key")
    apart = stage(placed.join(mixed_buckets, "key", "left_semi").select("key", "band", "node", "n", "label"), "apart")
    rows = apart.join(nodes.select("node", "signature"), "node")
    partners = stage(_with_partners(tile_pairs(rows, F.ceil(F.count("*") / settings.tile), "node", "n", "label", "band", "signature"), settings), "partners")
    if partners.isEmpty():
        return labels
    more = partners.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionAll(stage(sets_of(documents, nodes.select("node", "first").join(more, "node", "left_semi"), settings), "sets"))
    rows = apart.join(partners, ["key", "node"], "left_semi").join(sets, "node")
    between = stage(_joined(tile_pairs(rows, F.ceil(F.sum("n") / settings.tile_shingles), "label", "hashes"), settings), "between")
    further = connected_components(between).toDF("label", "further")
    every = labels.union(between.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").withColumn("label", F.col("node")))
    return stage(every.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "components")


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    documents = documents.select("doc_id", "text")
    rows = documents.select("doc_id", features(documents, settings).alias("_f")).select("doc_id", "_f.*")
    rows = stage(rows, "features")
    nodes = rows.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in ("n", "signature", "bands")]
    )
    nodes = stage(nodes, "nodes")
    labels = _components(documents, nodes, settings)
    known = nodes.select("node", "first").join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    known = stage(known, "known")
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"))
    of = stage(known.join(smallest, "label").select("node", "component_id"), "component-ids")
    linked = rows.filter("n > 0").select("doc_id", "n", "node")
    found = lookup_join(linked, of, ["node"], ["doc_id"], busy_keys(linked, ["node"])[0], how="inner").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


# Texts that share few shingles are never linked, so pairs are only counted where sizes allow.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT row_no, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: array_to_string(list_slice(w, p, p + 2), ' '))) END AS s FROM words),
nodes AS (SELECT min(row_no) AS node, min(doc_id) AS first, list(row_no) AS members, any_value(s) AS s, len(any_value(s)) AS n
  FROM (SELECT row_no, doc_id, s, md5(array_to_string(list_sort(s), chr(10))) AS digest FROM sets WHERE len(s) > 0) GROUP BY digest),
shingles AS (SELECT node, n, unnest(s) AS shingle FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b, any_value(a.n) + any_value(b.n) - count(*) AS together, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node < b.node AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.node, b.node),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * together),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
components AS (SELECT r.a AS node, min(n.first) AS component_id FROM reach r JOIN nodes n ON n.node = r.b GROUP BY r.a),
placed AS (SELECT unnest(n.members) AS row_no, c.component_id FROM nodes n JOIN components c USING (node))
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE p.component_id END AS component_id,
  coalesce(s.doc_id = CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE p.component_id END, false) AS kept
FROM sets s LEFT JOIN placed p USING (row_no)
"""
