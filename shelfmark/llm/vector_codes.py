"""Vector code compression: product codes learned with norm-of-sum bounds.

Every component becomes an integer, a vector is cut into equal parts, and each part position
has a codebook of integer entries, which a few rounds of means improve.  A part keeps its
entry without a new scan where bounds prove it: an upper bound of the distance to its own
entry and a lower bound of the distance to all others, each with the stamp of the round in
which it was exact.  The codebooks of all rounds are kept, so a bound is moved by the true
net displacement of an entry from the stamped round to the present one, which is never more
than the sum of its moves.  Where that proves nothing, the own distance is made exact, and
only what is still open is compared with the whole codebook.

Distances are exact in integers; bounds are rounded outwards, and a part is passed over only
if its own entry is strictly nearer, so ties always go to the lower index.

The rows are written between the rounds (the table of the round before is removed then), and
only sums for each entry, at most parts x entries of them, come to the driver.

Defined results: rows whose vector is NULL, empty, or holds NULL or non-finite components take
no part, nor do vectors of another length than most; repeated rows each count and get their
row; rows without vec_id come last among the first entries; components beyond +-131,072 count
as that; a length that is not a multiple of ``parts`` gives parts that differ by one; an error
sum beyond 64 bits is NULL; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.skew import busy_keys, lookup_join
from shelfmark.session import remove, new_shared_path

SCALE = 256
LARGEST = 1 << 25  # of an integer component, so that all sums of squares fit 64 bits
STATE = "code binary, upper binary, lower binary, upper_at binary, lower_at binary"


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64
    rounds: int = 2


class History:
    """The codebooks of all rounds so far, and how far each entry has moved since each of them."""

    def __init__(self, books: list[np.ndarray], cuts: list[int]):
        self.books, self.cuts = books, cuts
        now, parts = books[-1], len(cuts) - 1
        # by round and part: displacement of each entry, rounded up
        self.moved = np.stack(
            [
                np.stack([_up(np.sqrt(((now[:, a:b] - then[:, a:b]) ** 2).sum(axis=1).astype(np.float64))) for a, b in zip(cuts, cuts[1:])])
                for then in books
            ]
        ).reshape(len(books), parts, len(now))
        order = np.argsort(-self.moved, axis=2, kind="stable")
        self.farthest = order[:, :, 0]
        self.most = np.take_along_axis(self.moved, order[:, :, :1], axis=2)[:, :, 0]
        self.second = np.take_along_axis(self.moved, order[:, :, 1:2], axis=2)[:, :, 0] if len(now) > 1 else np.zeros_like(self.most)

    def others_moved(self, at: np.ndarray, part: int, code: np.ndarray) -> np.ndarray:
        """The largest displacement since round ``at`` of any entry but ``code``."""
        return np.where(self.farthest[at, part] == code, self.second[at, part], self.most[at, part])


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; floats are used while they are exact."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * largest * largest * max(1, x.shape[1]) < 1 << 53:
        x, book = x.astype(np.float64), book.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)).astype(np.int64)


@dataclass
class State:
    """Codes and bounds of some rows, a column for each part."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    upper_at: np.ndarray
    lower_at: np.ndarray

    @classmethod
    def empty(cls, n: int, parts: int) -> State:
        return cls(np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.uint8))


def assign(x: np.ndarray, state: State | None, history: History) -> tuple[State, int]:
    """The nearest entry of every part, and how many parts were compared with the whole codebook."""
    now, parts = len(history.books) - 1, len(history.cuts) - 1
    book, scanned = history.books[-1], 0
    state = state or State.empty(len(x), parts)
    out = State(*(getattr(state, k).copy() for k in ("code", "upper", "lower", "upper_at", "lower_at")))
    for p, (a, b) in enumerate(zip(history.cuts, history.cuts[1:])):
        code = state.code[:, p]
        low = state.lower[:, p] - history.others_moved(state.lower_at[:, p], p, code).astype(np.float64)
        high = state.upper[:, p] + history.moved[state.upper_at[:, p], p, code].astype(np.float64)
        open_ = np.flatnonzero(~(high < low))
        if len(open_):  # first the distance to the own entry alone
            own = x[open_, a:b] - book[code[open_], a:b]
            exact = _up(np.sqrt((own * own).sum(axis=1).astype(np.float64)))
            sure = exact.astype(np.float64) < low[open_]
            out.upper[open_[sure], p], out.upper_at[open_[sure], p] = exact[sure], now
            open_ = open_[~sure]
        if len(open_):
            scanned += len(open_)
            far = squared_distances(x[open_, a:b], book[:, a:b])
            near, rows = far.argmin(axis=1), np.arange(len(open_))
            best = far[rows, near]
            far[rows, near] = np.iinfo(np.int64).max
            other = np.sqrt(far.min(axis=1).astype(np.float64)) if len(book) > 1 else np.full(len(open_), np.inf)
            out.code[open_, p] = near
            out.upper[open_, p], out.lower[open_, p] = _up(np.sqrt(best.astype(np.float64))), _down(other)
            out.upper_at[open_, p] = out.lower_at[open_, p] = now
    return out, scanned


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and ``x``, the integer components, of the rows that take part."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("embedding") > 0)
    rows = rows.filter(F.coalesce(sound, F.lit(False)))
    edge = float(LARGEST)
    whole = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(-edge)), F.lit(edge))).cast("int"))
    return rows.select("vec_id", "label", whole.alias("x"))


def _matrix(x: pa.Array, dim: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _states(batch: pa.RecordBatch, parts: int) -> State | None:
    if "code" not in batch.schema.names:
        return None

    def read(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind).reshape(-1, parts)

    return State(read("code", np.uint8), read("upper", np.float32), read("lower", np.float32), read("upper_at", np.uint8), read("lower_at", np.uint8))


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values)], pa.binary())


def _assigned(rows: DataFrame, history: History, last: bool) -> DataFrame:
    """The rows with codes and bounds for the next round, or with code and error at the end."""
    shared, dim, parts = rows.sparkSession.sparkContext.broadcast(history), history.books[0].shape[1], len(history.cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("x"), dim)
            state, _ = assign(x, _states(batch, parts), known)
            columns = [batch.column("vec_id"), batch.column("label")]
            if last:
                error = np.zeros(len(x), dtype=np.int64)
                for p, (a, b) in enumerate(zip(known.cuts, known.cuts[1:])):
                    gap = x[:, a:b] - known.books[-1][state.code[:, p], a:b]
                    error += (gap * gap).sum(axis=1)
                names = ["vec_id", "label", "code", "error"]
                columns += [pa.array([row.tobytes().hex() for row in state.code], pa.string()), pa.array(error)]
            else:
                names = ["vec_id", "label", "x", "code", "upper", "lower", "upper_at", "lower_at"]
                columns += [batch.column("x"), *map(_binary, (state.code, state.upper, state.lower, state.upper_at, state.lower_at))]
            yield pa.RecordBatch.from_arrays(columns, names)

    types = dict(rows.dtypes)
    head = f"vec_id {types['vec_id']}, label {types['label']}, "
    return rows.mapInArrow(run, head + ("code string, error long" if last else f"x array<int>, {STATE}"))


def _means(rows: DataFrame, history: History) -> np.ndarray:
    """The next codebooks: sums of each task are combined by entry."""
    dim, n, cuts = history.books[0].shape[1], len(history.books[0]), history.cuts
    parts = len(cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((n, dim), dtype=np.int64), np.zeros((n, parts), dtype=np.int64)
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0), dim)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, parts)
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    np.add.at(sums[:, a:b], code[:, p], x[:, a:b])
                    counts[:, p] += np.bincount(code[:, p], minlength=n)
        entry, part = np.nonzero(counts)
        places = [np.arange(cuts[p], cuts[p + 1]) for p in part]
        if len(entry):
            yield pa.RecordBatch.from_arrays(
                [pa.array(entry), pa.array(part), pa.array(counts[entry, part]), pa.array([sums[e, at].tolist() for e, at in zip(entry, places)], pa.list_(pa.int64()))],
                ["entry", "part", "n", "sums"],
            )

    found = rows.select("x", "code").mapInArrow(run, "entry long, part long, n long, sums array<long>")
    # one group for each entry of each part, whatever the rows
    totals = found.select("entry", "part", "n", F.posexplode("sums").alias("place", "sum")).groupBy("entry", "part", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    after = history.books[-1].copy()
    for r in totals.collect():
        after[r["entry"], cuts[r["part"]] + r["place"]] = r["sum"] // r["n"]
    return after


def codebooks_digest(book: np.ndarray, cuts: list[int]) -> str:
    """sha256 of all components, by part, entry and place, as decimals joined by commas."""
    every = [str(v) for a, b in zip(cuts, cuts[1:]) for v in book[:, a:b].ravel().tolist()]
    return hashlib.sha256(",".join(every).encode()).hexdigest()


def compress(embeddings: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, label, code, error) of every row that takes part, the codebooks, and where the parts begin and end.

    ``code`` holds two hexadecimal digits for each part; there are 256 entries at most.
    """
    spark = embeddings.sparkSession
    before: str | None = None

    def stage(rows: DataFrame) -> DataFrame:
        # two tables at most lie in the shared folder at a time
        nonlocal before
        path = new_shared_path(spark, "vector-codes")
        rows.write.parquet(path)
        if before:
            remove(spark, before)
        before = path
        return spark.read.schema(rows.schema).parquet(path)

    rows = integers(embeddings)
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, label {dict(rows.dtypes)['label']}, code string, error long"), np.zeros((0, 0), np.int64), [0]
    dim = common[0]["dim"]
    rows = rows.filter(F.size("x") == dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(settings.entries).select("x").collect()
    cuts = [dim * p // settings.parts for p in range(settings.parts + 1)]
    books = [np.array([r["x"] for r in first], dtype=np.int64)]
    for _ in range(settings.rounds):
        rows = stage(_assigned(rows, History(books, cuts), last=False))
        books.append(_means(rows, History(books, cuts)))
    return stage(_assigned(rows, History(books, cuts), last=True)), books[-1], cuts


def codes(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that takes part."""
    rows, book, cuts = compress(embeddings, settings)
    # NULL is a label of its own
    rows = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = rows.groupBy("_label").agg(F.try_sum("error").alias("label_error"))
    joined = lookup_join(rows, sums, ["_label"], ["vec_id", "code"], busy_keys(rows, ["_label"])[0], how="inner")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(book, cuts)).alias("codebooks_sha256"))


def oracle_sql(settings: Settings = Settings(), dim: int = 64) -> str:
    """The same in SQL, for vectors of ``dim`` components."""
    size, parts, ctes = dim // settings.parts, settings.parts, []

    def mean(j: int) -> str:
        # integer division that goes down for negative sums as well
        s, n = f"sum(v[{j}])::HUGEINT", "count(*)::HUGEINT"
        return f"(({s} - (({s} % {n}) + {n}) % {n}) // {n})::BIGINT"

    for k in range(settings.rounds + 1):
        ctes.append(f"""near{k} AS (
  SELECT row_no, vec_id, p, v, arg_min(e, d * {settings.entries} + e) AS e, min(d) AS d
  FROM (SELECT x.row_no, x.vec_id, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM cut_parts x JOIN book{k} b ON x.p = b.p)
  GROUP BY row_no, vec_id, p, v)""")
        if k < settings.rounds:
            means = ", ".join(mean(j + 1) for j in range(size))
            ctes.append(f"""book{k + 1} AS (
  SELECT b.e, b.p, coalesce(m.v, b.v) AS v FROM book{k} b
  LEFT JOIN (SELECT p, e, [{means}] AS v FROM near{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    last = settings.rounds
    return f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_no, vec_id, label,
    list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut_parts AS (SELECT row_no, vec_id, p, list_slice(x, p * {size} + 1, (p + 1) * {size}) AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS (SELECT row_no AS e, p, v FROM cut_parts WHERE row_no < {settings.entries}),
{(',' + chr(10)).join(ctes)},
digest AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v)::VARCHAR AS c, generate_subscripts(v, 1) AS j FROM book{last})),
coded AS (SELECT row_no, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{last} GROUP BY row_no)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, g.codebooks_sha256
FROM kept k JOIN coded c USING (row_no), digest g"""
