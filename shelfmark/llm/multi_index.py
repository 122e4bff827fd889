"""Approximate nearest neighbours by an inverted multi-index.

Either half of a vector is quantised with a codebook of its own, so that a pair of centroids
names one of many fine cells.  A query walks the pairs in order of their summed distance, with
a heap over the two sorted halves, until the cells hold enough entries; those are reranked by
the exact inner product in double precision.

How many entries are enough, and whether half distances or half products order the pairs
better, is measured: a bounded sample of queries is compared with all rows, and the smallest
number that finds ``recall`` of their neighbours is taken.  It is never less than the wanted
neighbours and the query itself, so every query gets as many rows as there are candidates for.

Entries lie in tiles of bounded size: all cells of one first centroid, dealt into blocks where
they are many, against blocks of queries.  Every tile gives a query's best entries, and Spark
merges them.

Defined results: vectors that are NULL, zero or of another length than most, that hold NULL or
non-finite components, or that lack vec_id take no part; repeated rows of a vec_id count once,
with the smallest vector; fewer candidates than asked for give fewer rows; ties go to the
smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from shelfmark.session import stage

FOUND = "query_id long, vec_id long, score double"
PROBES = pa.list_(pa.struct([("first", pa.int32()), ("seconds", pa.list_(pa.int32()))]))


@dataclass(frozen=True)
class Settings:
    neighbours: int = 20
    sample: int = 20_000  # bound of the vectors that the codebooks are fitted on
    centroids: int = 256  # of each half, at most
    rounds: int = 10
    measured: int = 128  # bound of the queries that the number of entries is measured with
    recall: float = 0.96
    tile: int = 4096  # entries in a tile, and queries in a tile, on average at most
    seed: int = 1


@dataclass(frozen=True)
class Index:
    """The codebooks, how many entries each cell holds, and how far a query walks."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray  # first x second
    enough: int = 0
    by_product: bool = False

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return x[:, :cut], x[:, cut:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return _distances(a, self.first).argmin(axis=1) * len(self.second) + _distances(b, self.second).argmin(axis=1)

    def costs(self, x: np.ndarray, by_product: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return (-(a @ self.first.T), -(b @ self.second.T)) if by_product else (_distances(a, self.first), _distances(b, self.second))

    def walk(self, one: np.ndarray, two: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Cells in order of summed cost, until they hold ``enough`` entries; empty ones are passed over."""
        rows, columns = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
        one, two, sizes = one.tolist(), two.tolist(), self.sizes
        heap, reached, out, held = [(one[rows[0]] + two[columns[0]], 0, 0)], [0] * len(rows), [], 0
        while heap and held < enough:
            _, r, c = heapq.heappop(heap)
            i, j = rows[r], columns[c]
            n = int(sizes[i, j])
            if n:
                out.append((i, j))
                held += n
            reached[r] = c + 1
            # a pair follows both its neighbours before it
            if c + 1 < len(columns) and (r == 0 or reached[r - 1] > c + 1):
                heapq.heappush(heap, (one[i] + two[columns[c + 1]], r, c + 1))
            if r + 1 < len(rows) and reached[r + 1] == c:
                heapq.heappush(heap, (one[rows[r + 1]] + two[j], r + 1, c))
        return out


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def codebook(x: np.ndarray, size: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centroids of distinct rows."""
    distinct = np.unique(x, axis=0)
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), min(size, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        of = _distances(x, centroids).argmin(axis=1)
        counts = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def _matrix(vectors: pa.Array) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, one for each vec_id."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return rows
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter((F.size("embedding") == sizes[0]["n"]) & sound)
    if rows.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows


def best(queries: np.ndarray, query_ids: np.ndarray, entries: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places of its ``k`` best entries and their scores.

    A matrix product finds who may be among them; the scores are then summed in one fixed
    order, so that equal vectors have equal scores wherever they lie.
    """
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ entries.T
        rough[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        if allowed is not None:
            rough[~allowed[at : at + 256]] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        size = np.abs(rough, where=np.isfinite(rough), out=np.zeros_like(rough)).max(axis=1, initial=0)
        for q in range(len(rough)):
            near = np.flatnonzero((rough[q] >= least[q] - 1e-9 * (1 + size[q])) & np.isfinite(rough[q]))
            if len(near):
                scores = (queries[at + q] * entries[near]).sum(axis=1)
                order = np.lexsort((ids[near], -scores))[:k]
                yield at + q, near[order], scores[order]


def _merged(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The best ``k`` of each query, with their rank."""
    of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(of)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def _cells(rows: DataFrame, index: Index) -> Column:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.cells(_matrix(batch)) if len(batch) else [], pa.int32())

    return F.arrow_udf(run, "int")("embedding")


def _probes(queries: DataFrame, index: Index) -> Column:
    """For every query the cells it visits, by first centroid."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            out = []
            if len(batch):
                for one, two in zip(*known.costs(_matrix(batch), known.by_product)):
                    visited: dict[int, list[int]] = {}
                    for i, j in known.walk(one, two, known.enough):
                        visited.setdefault(i, []).append(j)
                    out.append([{"first": i, "seconds": js} for i, js in visited.items()])
            yield pa.array(out, PROBES)

    return F.arrow_udf(run, from_arrow_type(PROBES)).asNondeterministic()("embedding")


def exact_neighbours(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries among all rows, with the entries' cells."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        for batch in batches:
            if len(batch):
                entry_ids, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for q, at, scores in best(queries, query_ids, _matrix(batch.column(2)), entry_ids, k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), query_ids[q])), pa.array(entry_ids[at]), pa.array(scores), pa.array(cells[at])], ["query_id", "vec_id", "score", "cell"])

    return _merged(rows.select("vec_id", "cell", "embedding").mapInArrow(run, FOUND + ", cell int"), k, "cell")


def _chosen(rows: DataFrame, bound: int, n: int) -> DataFrame:
    """At most ``bound`` rows, by a hash of vec_id."""
    share = min(1.0, 1.2 * bound / max(1, n))
    place = F.xxhash64("vec_id")
    return rows.filter(F.pmod(place, F.lit(1 << 24)) <= share * (1 << 24)).orderBy(place, "vec_id").limit(bound)


def build(rows: DataFrame, n: int, settings: Settings) -> tuple[Index, DataFrame]:
    """Codebooks from a bounded sample, and all rows with their cell, written to the shared folder."""
    sample = _matrix(_chosen(rows, settings.sample, n).select("embedding").toArrow().column(0))
    k = int(np.clip(np.sqrt(n / 8), 4, settings.centroids))
    cut = sample.shape[1] // 2
    first = codebook(sample[:, :cut], k, settings.rounds, settings.seed)
    second = codebook(sample[:, cut:], k, settings.rounds, settings.seed + 1)
    index = Index(first, second, np.zeros((len(first), len(second)), dtype=np.int64))
    laid = stage(rows.withColumn("cell", _cells(rows, index)), "entries")
    for r in laid.groupBy("cell").count().collect():  # at most a row for each cell
        index.sizes[divmod(r["cell"], len(second))] = r["count"]
    return index, laid


def measured(index: Index, laid: DataFrame, queries: DataFrame, n_queries: int, settings: Settings) -> Index:
    """The index with the smallest number of entries that reaches the recall on a bounded sample of queries."""
    some = _chosen(queries, settings.measured, n_queries).select("vec_id", "embedding").toArrow()
    ids, vectors = some.column(0).to_numpy(), _matrix(some.column(1))
    truth = exact_neighbours(laid, ids, vectors, settings.neighbours).select("query_id", "cell").collect()
    cells: dict[int, list[int]] = {}
    for r in truth:
        cells.setdefault(r["query_id"], []).append(r["cell"])
    every, choices = int(index.sizes.sum()), []
    for by_product in (False, True):
        needed = []
        for q, one, two in zip(ids.tolist(), *index.costs(vectors, by_product)):
            # entries before a cell; a walk that stops there has not seen the cell
            total = (one[:, None] + two[None, :]).ravel()
            order = np.argsort(total, kind="stable")
            before = np.empty(len(order), dtype=np.int64)
            before[order] = np.concatenate([[0], np.cumsum(index.sizes.ravel()[order])[:-1]])
            needed += [before[c] + 1 for c in cells.get(q, [])]
        needed.sort()
        choices.append((needed[min(len(needed) - 1, int(np.ceil(settings.recall * len(needed))) - 1)] if needed else every, by_product))
    enough, by_product = min(choices)
    enough = max(enough, settings.neighbours + 1)  # the query's own row is an entry as well
    return Index(index.first, index.second, index.sizes, int(min(enough, every)), by_product)


def search(embeddings: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of every query's nearest entries."""
    spark, rows = embeddings.sparkSession, usable(embeddings)
    n, n_queries = rows.count(), rows.filter(is_query).count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, laid = build(rows, n, settings)
    queries = laid.filter(is_query)
    index = measured(index, laid, queries, n_queries, settings)
    seconds, k = len(index.second), settings.neighbours
    query_blocks = -(-n_queries // settings.tile)
    blocks = F.array(*[F.lit(max(1, -(-int(c) // settings.tile))) for c in index.sizes.sum(axis=1)])
    asked = (
        queries.select(F.col("vec_id").alias("query_id"), "embedding", F.explode(_probes(queries, index)).alias("_probe"))
        .select("query_id", "embedding", "_probe.first", "_probe.seconds", F.pmod(F.xxhash64("query_id"), F.lit(max(1, query_blocks))).cast("int").alias("query_block"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, "first") - 1)))
    )
    entries = (
        laid.withColumn("first", F.floor(F.col("cell") / seconds).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(blocks, "first")).cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(max(1, query_blocks) - 1))))
    )

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            query_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
            visited = np.zeros((len(query_ids), seconds), dtype=bool)
            for q, js in enumerate(left.column("seconds").to_pylist()):
                visited[q, js] = True
            allowed = visited[:, right.column("cell").to_numpy() % seconds]
            out = list(best(_matrix(left.column("embedding")), query_ids, _matrix(right.column("embedding")), ids, k, allowed))
        if not out:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        of = np.concatenate([np.full(len(at), query_ids[q]) for q, at, _ in out])
        return pa.table({"query_id": of, "vec_id": ids[np.concatenate([at for _, at, _ in out])], "score": np.concatenate([s for *_, s in out])})

    keys = ["first", "block", "query_block"]
    found = asked.groupBy(*keys).cogroup(entries.select("vec_id", "embedding", "cell", *keys).groupBy(*keys)).applyInArrow(tile, FOUND)
    return _merged(found, k)
