"""Changes to the index as snapshot transforms: ``index, changes, as_of -> index``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.fixed_values import APPROVE_ABOVE_STARS, REVIEWED_STATUSES
from shelfmark.operators import dedup

KEY = schemas.KEY
_HEX_DIGITS = 3  # 4096 buckets


def assign_ids(rows: DataFrame, after: Column, keys: list[str] = KEY) -> DataFrame:
    """Add dense ``id`` values above ``after``, ordered by (key hash bucket, key).

    A single global row number would sort everything in one task.  Here each hash
    bucket numbers its own rows and starts where the buckets before it end; the
    table of starts has at most 4096 rows.  Recomputing gives the same ids.
    """
    bucket = F.substring(F.md5(F.concat_ws("/", *keys)), 1, _HEX_DIGITS)
    placed = rows.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    numbered = placed.withColumn("_n", within).join(F.broadcast(starts), "_bucket")
    return numbered.withColumn("id", F.coalesce(after, F.lit(0)) + F.col("_start") + F.col("_n")).drop("_bucket", "_start", "_n")


def upsert(
    index: DataFrame,
    batch: DataFrame,
    as_of: Column,
    update_columns: list[str] | None = None,
    preserve_review: bool = False,
    buckets: int | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Insert new keys and update known ones; of batch rows with one key the largest counts.

    Callers that know the order of arrival reduce the batch by it before (``dedup.last_wins``).
    An update takes every column of the batch but the key and ``first_found_at``
    (or just ``update_columns``) and keeps ``id`` and ``created_at``.  With
    ``preserve_review`` a reviewed status survives rediscovery.

    Known and new keys are handled by a left and an anti join instead of one full
    outer join: a full outer join can never broadcast, so a small batch would move
    the whole index.  Here Spark may broadcast the batch after checking its size,
    and otherwise only the two key columns of the index are shuffled a second time.
    With ``buckets``, new rows are put together by key, as the rows of a bucketed
    index already are, so that the result can be written without another shuffle.

    Keys compare by bytes, or under a ``collation`` such as ``UNICODE_CI_AI_RTRIM``; a known row
    then keeps the spelling of the index.  Buckets go by bytes, so collated joins shuffle.
    """
    columns = index.columns
    batch, on = dedup.compared(batch, KEY, collation)
    index, _ = dedup.compared(index, KEY, collation)
    batch = dedup.one_row_per(batch, on)
    fixed = {*KEY, "first_found_at", "id", "created_at", "updated_at"}
    updatable = [c for c in batch.columns if c in columns and c not in fixed]
    if update_columns is not None:
        updatable = [c for c in updatable if c in update_columns]

    incoming = batch.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in updatable])
    hit = F.col("_hit")

    def updated(name: str) -> Column:
        if name == "updated_at":
            return F.when(hit, as_of).otherwise(F.col(name)).alias(name)
        if name not in updatable:
            return F.col(name)
        take = hit
        if name == "status" and preserve_review:
            take = hit & ~F.coalesce(F.col("status").isin(REVIEWED_STATUSES), F.lit(False))
        return F.when(take, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    kept = index.join(incoming, on, "left").select(*[updated(c) for c in columns])

    known = index.select(*on).join(batch.select(*on), on, "left_semi")
    fresh = batch.join(known, on, "left_anti")
    stamped = assign_ids(fresh, index.agg(F.max("id")).scalar())
    for name in ("created_at", "updated_at"):
        if name in columns:
            stamped = stamped.withColumn(name, as_of)
    have = set(stamped.columns)
    new = stamped.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(index.schema[c].dataType).alias(c) for c in columns]
    )
    return kept.unionByName(new.repartition(buckets, *KEY) if buckets else new)


def change_classes(
    index: DataFrame, current: DataFrame, validator: str = "skill_etag", fallback: str = "skill_sha", collation: str | None = None
) -> DataFrame:
    """Every key with unchanged / modified / new / gone, by comparing validators.

    Where either side lacks the validator, the content hashes are compared instead.  Under a
    ``collation`` a key that both sides have is spelled as in the index.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        second = F.col(fallback) if fallback in df.columns else F.lit(None).cast("string")
        rows = df.select(*KEY, F.col(validator).alias(f"_{prefix}"), second.alias(f"_{prefix}_hash"), F.lit(True).alias(f"_in_{prefix}"))
        rows, by = dedup.compared(rows, KEY, collation)
        rows = dedup.one_row_per(rows, by)
        return rows if collation is None else rows.withColumnsRenamed({k: f"_{prefix}_{k}" for k in KEY})

    old, now = side(index, "old"), side(current, "now")
    usable = F.col("_old").isNotNull() & F.col("_now").isNotNull()
    same = F.when(usable, F.col("_old") == F.col("_now")).otherwise(F.col("_old_hash") == F.col("_now_hash"))
    change = (
        F.when(F.col("_in_old").isNull(), "new")
        .when(F.col("_in_now").isNull(), "gone")
        .when(same, "unchanged")
        .otherwise("modified")
    )
    if collation is None:
        return old.join(now, KEY, "full").select(*KEY, change.alias("change"))
    spelled = [F.coalesce(f"_old_{k}", f"_now_{k}").alias(k) for k in KEY]
    return old.join(now, [f"_as_{k}" for k in KEY], "full").select(*spelled, change.alias("change"))


def new_keys(index: DataFrame, current: DataFrame, collation: str | None = None) -> DataFrame:
    """Keys that the index lacks, once each; of equal ones under a ``collation`` the largest by bytes."""
    keys, by = dedup.compared(current.select(*KEY), KEY, collation)
    known, _ = dedup.compared(index.select(*KEY), KEY, collation)
    return dedup.one_row_per(keys, by).join(known.select(*by), by, "left_anti").select(*KEY)


def vanished_keys(index: DataFrame, current: DataFrame, collation: str | None = None) -> DataFrame:
    keys, by = dedup.compared(index.select(*KEY), KEY, collation)
    now, _ = dedup.compared(current.select(*KEY), KEY, collation)
    return keys.join(now.select(*by), by, "left_anti").select(*KEY)


def _stamp(index: DataFrame, hit: Column, as_of: Column, values: dict[str, Column]) -> DataFrame:
    values = {**values, "updated_at": as_of}
    changed = {
        c: F.when(hit, v).otherwise(F.col(c) if c in index.columns else F.lit(None)) for c, v in values.items()
    }
    return index.withColumns(changed)


def rows_of(index: DataFrame, changes: DataFrame, on: list[str]) -> DataFrame:
    """The rows that changes name: what a change of them has to read and write."""
    return index.join(changes.select(*on).distinct(), on, "left_semi")


def set_status(index: DataFrame, changes: DataFrame, as_of: Column, order: list[str] | None = None) -> DataFrame:
    """Apply (id, new_status); ids that are not in the index do nothing.

    Of several changes of one id the last by ``order`` counts, or the largest status without one.
    """
    changes = dedup.one_row_per(changes.select("id", "new_status", *(order or [])), ["id"], order)
    joined = index.join(changes.select("id", "new_status"), "id", "left")
    return _stamp(joined, F.col("new_status").isNotNull(), as_of, {"status": F.col("new_status")}).drop("new_status")


def status_results(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether each requested change found its row."""
    known = index.select("id", F.lit(True).alias("_known"))
    return changes.join(known, "id", "left").withColumn("applied", F.coalesce("_known", F.lit(False))).drop("_known")


def mark_offline(index: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    return set_status(index, ids.select("id", F.lit("offline").alias("new_status")), as_of)


def touch_checked(index: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    joined = index.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return _stamp(joined, F.col("_hit").isNotNull(), as_of, {"last_checked_at": as_of}).drop("_hit")


def bulk_approve(index: DataFrame, as_of: Column, above_stars: int = APPROVE_ABOVE_STARS) -> DataFrame:
    pick = (F.col("stars") > above_stars) & (F.col("risk_level") == "low") & (F.col("status") == "pending")
    return _stamp(index, pick, as_of, {"status": F.lit("approved")})


def bulk_risky(index: DataFrame, as_of: Column) -> DataFrame:
    return _stamp(index, (F.col("risk_level") == "high") & (F.col("status") == "pending"), as_of, {"status": F.lit("risky")})


def bulk_review(index: DataFrame, as_of: Column) -> DataFrame:
    """Both bulk rules; they touch different rows, so the two projections fold into one pass."""
    return bulk_risky(bulk_approve(index, as_of), as_of)
