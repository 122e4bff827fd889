"""What the text operators share: per-text columns, folds and bounded learning samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# So many texts are Python strings at a time, whatever the size of an Arrow batch.
SLICE = 64


def texts_of(batch: pa.Array, size: int = SLICE) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, a slice at a time."""
    for at in range(0, len(batch), size):
        yield batch.slice(at, size).to_pylist()


def per_text(make: Callable[[], Callable[[str | None], object]], kind: pa.DataType, *columns: Column) -> Column:
    """A column of ``make()``'s results for each text; ``make`` runs once a task.

    Only these columns enter Python, in Arrow batches; the others of a row stay with
    Spark.  It counts as not deterministic, so that the optimizer never evaluates it twice.
    """

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            parts = [pa.array([each(t) for t in texts], type=kind) for texts in texts_of(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            parts = [
                pa.array([each(*row) for row in zip(*rows, strict=True)], type=kind)
                for rows in zip(*map(texts_of, batch), strict=True)
            ]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    run = one if len(columns) == 1 else several
    return F.arrow_udf(run, from_arrow_type(kind)).asNondeterministic()(*columns)


def per_slice(make: Callable[[], Callable[[list[str | None]], object]], kind: pa.DataType, column: Column) -> Column:
    """Like ``per_text``, with a call for each slice of texts, for what numpy does to many at once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            parts = [pa.array(each(texts), type=kind) for texts in texts_of(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return F.arrow_udf(run, from_arrow_type(kind)).asNondeterministic()(column)


def free_name(rows: DataFrame, wanted: str) -> str:
    """``wanted``, with as many ``_`` as it takes to be no column of ``rows``, whatever the letters' case."""
    taken = {c.lower() for c in rows.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo ``folds``; NULL for a NULL key."""
    return F.crc32(key.cast("string")) % folds


def held_out(key: Column, folds: int, which: int) -> Column:
    """Whether a row is kept from learning; a row without key always is."""
    return F.coalesce(fold(key, folds) == which, F.lit(True))


def sample_by_class(rows: DataFrame, label: str, order: list[str], per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``label``, twice that at most, chosen by a hash of ``order``.

    The choice depends on the values alone, not on partitions.  Classes are few: their
    counts come to the driver.
    """
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect() if r[label] is not None}
    if not sizes:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_class / n))])[F.col(label)]
    place = F.pmod(F.xxhash64(*order), F.lit(1 << 24)) / float(1 << 24) / share
    # keys that repeat may pass together, hence the limit
    return rows.withColumn("_place", place).filter("_place < 1").orderBy("_place", *order).limit(2 * per_class * len(sizes)).drop("_place")


def learning_texts(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts: about ``per_class`` documents of either label.

    ``labels`` is sampled by key first, so only sampled texts move; at most
    ``2 * per_class`` keys a class are broadcast.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    known = known.filter(learn)
    chosen = sample_by_class(known, "_label", ["_id"], per_class)
    rows = (
        documents.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .select("_id", "_label", "_text")
        .orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"), "_label")
        .limit(4 * per_class)
        .collect()
    )
    return [r["_text"] for r in rows], [r["_label"] for r in rows]


def is_learned(folds: int, which: int) -> Column:
    """For ``learning_texts``: keys outside the fold that is held out."""
    return fold(F.col("_id"), folds) != which
