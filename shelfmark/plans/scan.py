"""Acquisition from the trees of known repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import refs
from shelfmark.functions.risk import DEFAULT_RULES
from shelfmark.operators.dedup import one_row_per
from shelfmark.operators.skew import Busy, lookup_join
from shelfmark.plans.records import build_records, busy_candidates
from shelfmark.session import stage

SOURCE = "trusted_repo"


def manifest_blobs(tree: DataFrame) -> DataFrame:
    return tree.filter(refs.is_manifest_blob(F.col("path"), F.col("type")))


def with_addresses(files: DataFrame, source_type: str) -> DataFrame:
    """Candidate columns for (repo_full_name, skill_path, default_branch)."""
    repo, path, branch = F.col("repo_full_name"), F.col("skill_path"), F.col("default_branch")
    return files.withColumns(
        {
            "skill_html_url": refs.page_url(repo, branch, path),
            "skill_api_url": refs.contents_api_url(repo, path),
            "repo_owner": refs.repo_owner(repo),
            "repo_url": refs.repo_url(repo),
            "source_type": F.lit(source_type),
        }
    )


def scan_candidates(tree: DataFrame, scope: DataFrame, repos: DataFrame, busy: Busy = Busy(), trees: DataFrame | None = None) -> DataFrame:
    """Manifest files of the repositories in scope; a repository without statistics is passed over.

    With ``trees`` (``landing.trees_read``) each has ``seen_in_part``: whether its repository may hold more files.
    """
    branches = one_row_per(repos.select("repo_full_name", F.col("repo_default_branch").alias("default_branch")), ["repo_full_name"])
    readable = scope.select("repo_full_name").distinct().join(branches, "repo_full_name")
    if trees is not None:  # one row per repository, before the files of the trees are joined
        cut = trees.select("repo_full_name", F.col("truncated").alias("seen_in_part"))
        readable = readable.join(cut, "repo_full_name", "left").fillna(False, ["seen_in_part"])
    blobs = manifest_blobs(tree).select("repo_full_name", F.col("path").alias("skill_path"))
    files = lookup_join(blobs, readable, ["repo_full_name"], ["skill_path"], busy, how="inner")
    return with_addresses(files, SOURCE)


def scan_coverage(tree: DataFrame, scope: DataFrame, repos: DataFrame, trees: DataFrame) -> DataFrame:
    """One row per repository in scope: ``seen`` whole, in part, without a tree or without statistics, and its manifest files.

    A repository that is seen in part and has no manifest file leaves no disposition; it shows here.
    """
    counted = manifest_blobs(tree).select("repo_full_name", "path").distinct().groupBy("repo_full_name").agg(F.count("*").alias("n_files"))
    known = repos.select("repo_full_name").distinct().withColumn("_known", F.lit(True))
    asked = scope.select("repo_full_name").distinct()
    for side in (known, trees.select("repo_full_name", "truncated"), counted):
        asked = asked.join(side, "repo_full_name", "left")
    seen = (
        F.when(F.col("_known").isNull(), "no statistics")
        .when(F.col("truncated").isNull(), "no tree")
        .when(F.col("truncated"), "in part")
        .otherwise("whole")
    )
    return asked.select("repo_full_name", seen.alias("seen"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


def scan_dispositions(
    tree: DataFrame,
    scope: DataFrame,
    contents: DataFrame,
    repos: DataFrame,
    layout: DataFrame,
    as_of: Column,
    rules=DEFAULT_RULES,
    trees: DataFrame | None = None,
) -> DataFrame:
    # the tree is read once; what follows needs only its manifest files
    blobs = stage(manifest_blobs(tree).select("repo_full_name", "path", "type").distinct(), "manifests")
    named = blobs.select("repo_full_name", F.col("path").alias("skill_path"), F.lit("").alias("default_branch"))
    busy = busy_candidates(with_addresses(named, SOURCE))
    files = scan_candidates(blobs, scope, repos, busy[1], trees)
    return stage(build_records(files, contents, repos, layout, as_of, rules, busy), "dispositions")
