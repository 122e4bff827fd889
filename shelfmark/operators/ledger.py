"""The ledger of runs: one event per transition, folded to the latest state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.fixed_values import RUN_STATUSES


def event(
    spark: SparkSession,
    run_id: int,
    name: str,
    at: datetime,
    task_type: str | None = None,
    query_text: str | None = None,
    found: int = 0,
    saved: int = 0,
    skipped: int = 0,
    error: str | None = None,
) -> DataFrame:
    """One ``created`` / ``started`` / ``finished`` event; a failure is a finish with an error."""
    seq = {"created": 0, "started": 1, "finished": 2}[name]
    row = (run_id, seq, name, task_type, query_text, found, saved, skipped, error, at)
    return spark.createDataFrame([row], schemas.RUN_EVENTS)


def current_state(events: DataFrame) -> DataFrame:
    """One row per run from its events; totals are zero until it finishes."""
    seq = F.col("seq")
    has_error = F.coalesce(F.col("error_message"), F.lit("")) != ""
    status = (
        F.when(F.col("event") == "created", "pending")
        .when(F.col("event") == "started", "running")
        .when(has_error, "failed")
        .otherwise("success")
    )

    def total(name: str) -> Column:
        return F.when(F.col("event") == "finished", F.coalesce(name, F.lit(0))).otherwise(F.lit(0)).alias(name)

    totals = ["total_found", "total_saved", "total_skipped"]
    last = F.struct(status.alias("status"), *[total(t) for t in totals], "error_message")

    def time_of(name: str) -> Column:
        return F.max(F.when(F.col("event") == name, F.col("at")))

    folded = events.groupBy("run_id").agg(
        F.min_by("task_type", F.when(F.col("task_type").isNotNull(), seq)).alias("task_type"),
        F.min_by("query_text", F.when(F.col("query_text").isNotNull(), seq)).alias("query_text"),
        F.max_by(last, seq).alias("last"),
        time_of("created").alias("created_at"),
        time_of("started").alias("started_at"),
        time_of("finished").alias("finished_at"),
    )
    return with_failed(
        folded.select("run_id", "task_type", "query_text", "last.*", "created_at", "started_at", "finished_at")
    )


def with_failed(runs: DataFrame) -> DataFrame:
    """``total_failed`` is derived and may be negative, because skipped counts duplicates too."""
    return runs.withColumn("total_failed", F.col("total_found") - F.col("total_saved") - F.col("total_skipped"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Total and the four states in one pass."""
    return runs.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in RUN_STATUSES]
    )


def recent_runs(runs: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    top = runs.orderBy(F.col("created_at").desc(), F.col(key).desc()).limit(n)
    return top.select(key, "task_type", "status", "total_found", "total_saved")
