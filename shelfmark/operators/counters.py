"""Run counters as sums over disposition rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["found", "saved", "skipped", "failed"]
REFRESH_COUNTS = ["checked", "updated", "not_modified", "offline", "failed"]


def acquisition_counters(dispositions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """found / saved / skipped / failed, per ``by`` columns or in all."""
    sums = [F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(f"total_{c}") for c in COUNTS]
    return (dispositions.groupBy(*by) if by else dispositions).agg(*sums)


def refresh_counters(changes: DataFrame) -> DataFrame:
    """checked / updated / not_modified / offline / failed from the ``effect`` column.

    A file whose new content is unusable counts as failed but not as checked.
    """
    effect = F.col("effect")

    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    return changes.agg(
        n(effect.isin("updated", "not_modified", "offline", "error"), "checked"),
        n(effect == "updated", "updated"),
        n(effect == "not_modified", "not_modified"),
        n(effect == "offline", "offline"),
        n(effect.isin("unusable", "error"), "failed"),
    )
