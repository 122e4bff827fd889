"""Near duplicates by SimHash: tiled exact comparison of fingerprints.

Distinct fingerprints are laid in tiles by the population counts of their four 16-bit
quarters.  Two fingerprints within ``radius`` bits have quarter counts that differ by
``radius`` in sum at most, so only such pairs of tiles are compared, with numpy's exclusive
or and bit counts.  Larger groups of equal counts fall into several tiles of bounded size;
all pairs of those are compared.

Defined results: NULL or empty text has fingerprint zero, and is linked like any other;
repeated rows each get their row; a component without any non-NULL doc_id has a NULL
component_id.  Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import free_name, per_text
from shelfmark.llm.components import connected_components
from shelfmark.session import stage

SEED = 42
SHINGLE = 3
RADIUS = 2
# Fingerprints in a tile, on average at most; a pair of tiles is one unit of work.
TILE = 4096
QUARTERS = 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BIT_ROWS = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included, as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    last = min(shingle, len(words)) - 1
    starts = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.append(gaps, len(joined)).tolist()[last:]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(ends), _BIT_ROWS):
        spans = zip(starts[at : at + _BIT_ROWS], ends[at : at + _BIT_ROWS])
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), dtype=np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(ends)).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, text: str = "text") -> Column:
    return per_text(lambda: fingerprint, pa.int64(), F.col(text))


def _quarter_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(QUARTERS)]


def _profile(counts: list[Column]) -> Column:
    key = counts[0]
    for c in counts[1:]:
        key = key * 17 + c
    return key.cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts within the radius, one of each pair of opposites."""
    found = [()]
    for _ in range(QUARTERS):
        found = [(*o, d) for o in found for d in range(-radius, radius + 1) if sum(map(abs, o)) + abs(d) <= radius]
    return [o for o in found if o >= (0,) * QUARTERS]


def tiles(distinct: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(profile, block, fps) of distinct fingerprints ``fp``, and (profile, blocks).

    There are 17**4 profiles at most, whatever the input.
    """
    rows = distinct.select("fp", _profile(_quarter_counts(F.col("fp"))).alias("profile"))
    sizes = rows.groupBy("profile").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    sizes = stage(sizes, "sizes")
    laid = (
        rows.join(F.broadcast(sizes), "profile")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .groupBy("profile", "block")
        .agg(F.collect_list("fp").alias("fps"))
    )
    return stage(laid, "tiles"), sizes


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 64) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles (or within one, given twice).

    It connects what the links connect, with fewer pairs than fingerprints.
    """
    label = np.arange(len(a) + len(b))
    if a is b:
        label[len(a) :] = label[: len(a)]
    found = []
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        for k in np.flatnonzero(near.any(axis=1)):
            i = at + int(k)
            hits = np.flatnonzero(near[k])
            roots, first = np.unique(label[len(a) + hits], return_index=True)
            for root, j in zip(roots, hits[first]):
                if root != label[i]:
                    found.append((i, int(j)))
                    label[label == root] = label[i]
    return [(int(a[i].astype(np.int64)), int(b[j].astype(np.int64))) for i, j in found]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints within the radius of each other."""
    laid, sizes = tiles(distinct, tile)
    counts = [F.expr(f"(profile div {17 ** (QUARTERS - 1 - k)}) % 17") for k in range(QUARTERS)]
    near = F.array(
        *[
            F.when(
                sum((F.when((c + d).between(0, 16), 0).otherwise(1) for c, d in zip(counts, o)), F.lit(0)) == 0,
                F.col("profile") + sum(d * 17 ** (QUARTERS - 1 - k) for k, d in enumerate(o)),
            )
            for o in _offsets(radius)
        ]
    )
    there = sizes.select(F.col("profile").alias("profile_b"), "blocks")
    pairs = (
        laid.select("profile", "block", F.col("fps").alias("fps_a"), F.explode(F.array_compact(near)).alias("profile_b"))
        .join(F.broadcast(there), "profile_b")
        .withColumn("block_b", F.explode(F.expr("sequence(0, blocks - 1)")))
        .filter("profile <> profile_b OR block <= block_b")
        .join(laid.select(F.col("profile").alias("profile_b"), F.col("block").alias("block_b"), F.col("fps").alias("fps_b")), ["profile_b", "block_b"])
        .select((F.expr("profile = profile_b AND block = block_b")).alias("same"), "fps_a", "fps_b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                a = batch.column(1)[k].values.to_numpy().view(np.uint64)
                b = a if batch.column(0)[k].as_py() else batch.column(2)[k].values.to_numpy().view(np.uint64)
                out = tile_links(a, b, radius)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Every document with its class: doc_id, fp (signed), fingerprint (hexadecimal), component_id."""
    rows = stage(documents.select("doc_id", "text").select("doc_id", fingerprints(documents).alias("fp")), "fingerprints")
    of = _components(rows, radius, tile).select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Of every distinct fingerprint: fp, label of its component, component_id."""
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = connected_components(stage(links(distinct.select("fp"), radius, tile), "links"))
    known = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    known = stage(known, "known")
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"))
    return stage(known.join(smallest, "label").select("fp", "label", "component_id"), "components")


def one_of_each(documents: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all its columns.

    Of repeated rows of that doc_id in the component one stays; a component without any
    doc_id keeps one row as well.
    """
    rows = stage(documents.select("doc_id", "text").select("doc_id", fingerprints(documents).alias("fp")), "fingerprints")
    of = _components(rows, radius, tile)
    heads = (
        rows.filter("doc_id IS NOT NULL")
        .join(of, "fp")
        .groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.max(F.expr("doc_id = component_id")).alias("head"))
        .filter("head")
    )
    heads = stage(heads.select("doc_id", "n"), "heads")
    # the narrow side is hashed, so that the texts are shuffled once but not sorted; the same way at every size
    single = documents.join(heads.filter("n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    # ids that repeat, or are missing: the fingerprint says which component a row is of
    again = documents.join(heads.filter("n > 1").select("doc_id"), "doc_id", "left_semi")
    fp, label, component = (free_name(documents, name) for name in ("_fp", "_label", "_component"))
    again = again.unionByName(documents.filter("doc_id IS NULL")).withColumn(fp, fingerprints(documents))
    again = again.join(of.select(F.col("fp").alias(fp), F.col("label").alias(label), F.col("component_id").alias(component)), fp)
    again = again.filter(F.col("doc_id").eqNullSafe(F.col(component))).dropDuplicates([label])
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return single.select(*columns).unionAll(again.select(*columns))
