"""The statistics report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import ledger, review


def report(index: DataFrame, runs: DataFrame) -> DataFrame:
    """(section, label, value): index states, run states and the five newest rows.

    Two single-pass aggregates and one top-k.
    """
    states = review.dashboard_rows(index).select(
        F.lit("index").alias("section"), F.col("status").alias("label"), F.col("n").cast("string").alias("value")
    )
    names = ["total", "pending", "running", "success", "failed"]
    tasks = ledger.run_stats(runs).unpivot([], names, "label", "n")
    task_rows = tasks.select(F.lit("runs").alias("section"), "label", F.col("n").cast("string").alias("value"))
    newest = review.recent(index, 5).select(
        F.lit("recent").alias("section"),
        F.col("name").alias("label"),
        F.concat_ws(" | ", "repo_full_name", F.col("stars").cast("string"), "risk_level", "status").alias("value"),
    )
    return states.unionByName(task_rows).unionByName(newest)
