"""Look-ups, queues, listings and status counts over the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed_values import DASHBOARD_STATUSES, RECHECK_DAYS


# --- point look-ups (pushed down to the scan) ---
def by_id(index: DataFrame, id_: int) -> DataFrame:
    return index.filter(F.col("id") == id_)


def by_repo_and_path(index: DataFrame, repo: str, path: str) -> DataFrame:
    return index.filter((F.col("repo_full_name") == repo) & (F.col("skill_path") == path))


def by_repo(index: DataFrame, repo: str) -> DataFrame:
    return index.filter(F.col("repo_full_name") == repo)


def by_keys(index: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Many look-ups at once."""
    return index.join(wanted.select(*keys), keys, "left_semi")


# --- queues and listings (each a distributed top-k) ---
def _first(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def pending_queue(index: DataFrame, n: int | None = 100) -> DataFrame:
    pending = index.filter(F.col("status") == "pending")
    return _first(pending.orderBy(F.col("created_at").desc(), "id"), n)


def update_queue(index: DataFrame, n: int | None = 100) -> DataFrame:
    """Approved rows, never checked first, then longest unchecked."""
    approved = index.filter(F.col("status") == "approved")
    if n is None:  # everything is due: order has no effect on the result
        return approved
    return approved.orderBy(F.col("last_checked_at").asc_nulls_first(), "id").limit(n)


def recent(index: DataFrame, n: int = 5) -> DataFrame:
    return index.orderBy(F.col("created_at").desc(), "id").limit(n)


def listing(index: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = index if status is None else index.filter(F.col("status") == status)
    return rows.orderBy("id").offset(offset).limit(limit)


def listing_after(index: DataFrame, after_id: int, status: str | None = None, limit: int = 100) -> DataFrame:
    """The same pages by position in the id order: a deep page costs what the first one does."""
    return listing(index.filter(F.col("id") > after_id), status, limit)


def due_for_check(index: DataFrame, as_of: Column, days: dict[str, int] = RECHECK_DAYS, n: int | None = None) -> DataFrame:
    """Rows whose status-dependent re-check interval has passed, longest unchecked first."""
    policy = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
    interval = F.element_at(policy, F.col("status"))
    due_at = F.col("last_checked_at") + F.make_dt_interval(interval)
    due = index.filter(interval.isNotNull() & (F.col("last_checked_at").isNull() | (due_at <= as_of)))
    if n is None:
        return due
    return due.orderBy(F.col("last_checked_at").asc_nulls_first(), "id").limit(n)


def sample_saved(records: DataFrame, arrival: list[str], n: int = 5) -> DataFrame:
    return records.orderBy(*arrival).limit(n)


# --- counts ---
def count_status(index: DataFrame, status: str) -> DataFrame:
    return index.filter(F.col("status") == status).agg(F.count("*").alias("n"))


def dashboard(index: DataFrame) -> DataFrame:
    """One row with the five reviewed-index states, zeros included, and their total."""
    counts = index.agg(*[F.count_if(F.col("status") == s).alias(s) for s in DASHBOARD_STATUSES])
    total = sum((F.col(s) for s in DASHBOARD_STATUSES[1:]), F.col(DASHBOARD_STATUSES[0]))
    return counts.withColumn("total", total)


def dashboard_rows(index: DataFrame) -> DataFrame:
    """The dashboard as (status, n)."""
    return dashboard(index).unpivot([], [*DASHBOARD_STATUSES, "total"], "status", "n")


def status_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("status").agg(F.count("*").alias("n"))


def status_map(index: DataFrame) -> DataFrame:
    """One map of status to count; it has as many entries as there are states."""
    pairs = F.sort_array(F.collect_list(F.struct("status", "n")))
    return status_counts(index).agg(F.map_from_entries(pairs).alias("counts"))
