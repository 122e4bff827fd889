"""Which known subdirectories lie next to a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.fixed_values import LAYOUT_DIRECTORIES
from shelfmark.functions.refs import skill_dir
from shelfmark.operators.skew import Busy, lookup_join

FLAGS = list(LAYOUT_DIRECTORIES)
_NAMES = [n for names in LAYOUT_DIRECTORIES.values() for n in names]


def _flag_aggregates(name: Column) -> list[Column]:
    return [F.bool_or(name.isin(names)).alias(flag) for flag, names in LAYOUT_DIRECTORIES.items()]


def flags_from_listing(listing: DataFrame) -> DataFrame:
    """Four flags per listed directory, from its entries of type ``dir``."""
    name = F.when(F.col("type") == "dir", F.lower("name"))
    known = listing.withColumn("_name", F.coalesce(name, F.lit("")))
    return known.groupBy("repo_full_name", "dir").agg(*_flag_aggregates(F.col("_name")))


def known_children(tree: DataFrame) -> DataFrame:
    """One row per (path, ancestor directory) whose next component is a known directory.

    Work is linear in path depth.  Comparing every path with every directory of
    its repository instead would be quadratic in the size of a repository.
    """
    parts = F.split("path", "/", -1)
    # a component counts as a directory only if something follows it
    places = F.filter(
        F.sequence(F.lit(1), F.size(parts) - 2),
        lambda i: F.lower(F.get(parts, i)).isin(_NAMES),
    )
    deep = tree.filter(F.size(parts) > 2).withColumn("_i", F.explode(places))
    return deep.select(
        "repo_full_name",
        "path",
        "type",
        F.array_join(F.slice(parts, F.lit(1), F.col("_i")), "/").alias("dir"),
        F.lower(F.get(parts, F.col("_i"))).alias("child"),
    )


def flags_from_tree(tree: DataFrame) -> DataFrame:
    """Four flags per directory of a recursive tree that has at least one of them."""
    return known_children(tree).groupBy("repo_full_name", "dir").agg(*_flag_aggregates(F.col("child")))


def counts_from_tree(tree: DataFrame) -> DataFrame:
    """The flags plus how many files lie under scripts, assets and references."""
    is_file = F.col("type") == "blob"
    counts = [
        F.count_if(is_file & F.col("child").isin(LAYOUT_DIRECTORIES[flag])).alias(flag.replace("has_", "") + "_count")
        for flag in ("has_scripts", "has_assets", "has_references")
    ]
    return known_children(tree).groupBy("repo_full_name", "dir").agg(*_flag_aggregates(F.col("child")), *counts)


def place(files: DataFrame) -> DataFrame:
    """Add ``dir``, the directory whose flags a file gets; NULL at the repository root."""
    folder = skill_dir(F.col("skill_path"))
    return files.withColumn("dir", F.when(folder != "", F.rtrim(folder, F.lit("/"))))


def attach_flags(files: DataFrame, flags: DataFrame, busy: Busy = Busy()) -> DataFrame:
    """Files with the flags of their directory; a file at the repository root has none."""
    joined = lookup_join(place(files), flags, ["repo_full_name", "dir"], ["skill_path"], busy)
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS}).drop("dir")
