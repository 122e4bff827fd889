"""Joins that keep their shape when one key holds a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with fewer rows than this is no burden for one task.
BUSY_ROWS = 200_000
# A key that escapes the sketch holds less than about 1/TRACKED of the rows.
LISTED, TRACKED = 1_000, 10_000
MOST_SPLITS = 4_096


@dataclass(frozen=True)
class Busy:
    """Busy values of a join key, each with the number of tasks it has to be spread over, and the same for rows without a key.

    Keys that the sketch leaves out are plain rows of the join; should one of them still be
    large for its partition, adaptive execution splits that partition.
    """

    splits: tuple[tuple[str, int], ...] = ()
    null_splits: int = 1


def _marker(keys: list[str]) -> Column:
    """The key as one text, NULL when a part of it is."""
    first, *others = [F.col(k).cast("string") for k in keys]
    return F.concat(first, *[F.concat(F.lit("\x1f"), part) for part in others])


def _splits(count: int, at_least: int) -> int:
    return min(MOST_SPLITS, max(2, -(-count // at_least)))


def busy_keys(df: DataFrame, *key_sets: list[str], at_least: int = BUSY_ROWS) -> list[Busy]:
    """Busy values of each key set, from one pass over ``df``.

    A frequent-items sketch per key set: every task sends a bounded summary, no
    key is shuffled, and at most ``LISTED`` values per set reach the driver.  The
    counts are estimates, which is enough because they only decide how rows are
    spread, never what a join returns.
    """
    aggs = []
    for n, keys in enumerate(key_sets):
        aggs.append(F.expr(f"approx_top_k(_k{n}, {LISTED}, {TRACKED})").alias(f"top{n}"))
        aggs.append(F.count_if(F.col(f"_k{n}").isNull()).alias(f"nulls{n}"))
    row = df.select(*[_marker(keys).alias(f"_k{n}") for n, keys in enumerate(key_sets)]).agg(*aggs).first()
    found = []
    for n in range(len(key_sets)):
        top = [(r["item"], r["count"]) for r in row[f"top{n}"] or [] if r["item"] is not None and r["count"] >= at_least]
        nulls = row[f"nulls{n}"]
        found.append(
            Busy(tuple((item, _splits(count, at_least)) for item, count in top), _splits(nulls, at_least) if nulls >= at_least else 1)
        )
    return found


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], spread_on: list[str], busy: Busy = Busy(), how: str = "left"
) -> DataFrame:
    """Join facts to a table with one row per key.

    Rows of a busy key get a salt from ``spread_on`` and meet one copy of the lookup
    row per salt; rows without a key match nothing and are spread the same way.  The
    result is that of the plain join, which is what runs when nothing is busy.
    """
    if busy == Busy():
        return facts.join(lookup, keys, how)
    marker, splits = _marker(keys), F.lit(1)
    if busy.splits:
        known = F.create_map(*[F.lit(x) for pair in busy.splits for x in pair])
        splits = F.coalesce(F.element_at(known, marker), F.lit(1))
    spread = F.when(marker.isNull(), F.lit(busy.null_splits)).otherwise(splits)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), spread).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
