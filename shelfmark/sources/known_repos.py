"""Known repositories: seeds, scope and scan times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.fixed_values import SEED_REPOSITORIES
from shelfmark.functions import refs


def seed_rows(spark: SparkSession, as_of: Column) -> DataFrame:
    seeds = spark.createDataFrame(SEED_REPOSITORIES, "repo_full_name STRING, source_level STRING")
    full = seeds.withColumns(
        {
            "repo_url": refs.repo_url(F.col("repo_full_name")),
            "scan_enabled": F.lit(1).cast("smallint"),
            "last_scanned_at": F.lit(None).cast("timestamp"),
            "created_at": as_of,
            "updated_at": as_of,
        }
    )
    return full.select(*schemas.KNOWN_REPOS.names)


def only_if_empty(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` when ``existing`` has none, nothing otherwise.

    The right side is at most one row, so this is an anti join with a single
    key value on the small side, not a comparison of two tables.
    """
    marker = existing.limit(1).select(F.lit(1).alias("_one"))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(marker), "_one", "left_anti").drop("_one")


def with_seeds(existing: DataFrame, as_of: Column) -> DataFrame:
    """The table itself, or the seeds if it is empty."""
    seeds = only_if_empty(seed_rows(existing.sparkSession, as_of), existing)
    return existing.unionByName(seeds, allowMissingColumns=True)


def enabled(known: DataFrame) -> DataFrame:
    return known.filter(F.col("scan_enabled") == 1)


def scan_scope(known: DataFrame, repo: str | None = None) -> DataFrame:
    """Names to scan: one given repository, else the enabled ones, else the seeds."""
    spark = known.sparkSession
    if repo is not None:
        return spark.createDataFrame([(repo,)], "repo_full_name STRING")
    names = enabled(known).select("repo_full_name").distinct()
    seeds = spark.createDataFrame([(r,) for r, _ in SEED_REPOSITORIES], "repo_full_name STRING")
    return names.unionByName(only_if_empty(seeds, names))


def touch_scanned(known: DataFrame, scanned: DataFrame, as_of: Column) -> DataFrame:
    """Stamp the scanned repositories; names that are not in the table are ignored."""
    hit = scanned.select("repo_full_name").distinct().withColumn("_hit", F.lit(True))
    joined = known.join(hit, "repo_full_name", "left")
    stamped = {
        c: F.when(F.col("_hit"), as_of).otherwise(F.col(c)) if c in known.columns else F.when(F.col("_hit"), as_of)
        for c in ("last_scanned_at", "updated_at")
    }
    return joined.withColumns(stamped).drop("_hit")
