"""Acquisition from submitted repository references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import refs
from shelfmark.functions.risk import DEFAULT_RULES
from shelfmark.functions.text import blank_to_null
from shelfmark.operators.dedup import one_row_per
from shelfmark.operators.skew import Busy, busy_keys, lookup_join
from shelfmark.plans.records import build_records, busy_candidates, count_only
from shelfmark.plans.scan import manifest_blobs, with_addresses
from shelfmark.session import stage

SOURCE = "user_submit"


def targets(submissions: DataFrame) -> DataFrame:
    """Distinct (repository, path) with ``n_requests``; no path means the whole repository.

    Equal requests have equal results, so a popular repository is resolved once
    and weighed by its number of submissions.  ``path`` is optional and wins over
    the path in the reference.  Unreadable references have no repository.
    """
    url = F.col("url")
    given = blank_to_null(F.col("path")) if "path" in submissions.columns else F.lit(None).cast("string")
    named = submissions.select(
        refs.referenced_repo(url).alias("repo_full_name"), given.alias("given"), refs.referenced_path(url).alias("in_url")
    ).select(
        "repo_full_name",
        F.when(F.col("repo_full_name").isNotNull(), F.coalesce("given", "in_url")).alias("skill_path"),
    )
    return named.groupBy("repo_full_name", "skill_path").agg(F.count("*").alias("n_requests"))


def resolve(
    submitted: DataFrame, repos: DataFrame, tree: DataFrame, trees: DataFrame, busy: Busy = Busy(), busy_tree: Busy = Busy()
) -> tuple[DataFrame, DataFrame]:
    """Split targets into candidate files and failures.

    ``trees`` names the repositories whose tree could be read (it may be empty); with a column
    ``truncated`` each file has ``seen_in_part``, true where it was found in a tree that left entries out;
    the two ``busy`` tell which repositories fill the targets and the trees.
    """
    known = one_row_per(repos.select("repo_full_name", F.col("repo_default_branch").alias("default_branch")), ["repo_full_name"])
    checked = lookup_join(submitted, known, ["repo_full_name"], ["skill_path"], busy)
    exists = F.col("default_branch").isNotNull()
    has_path = F.col("skill_path").isNotNull()

    single = checked.filter(exists & has_path & refs.is_manifest_path(F.col("skill_path")))
    cut = F.col("truncated") if "truncated" in trees.columns else F.lit(False)
    whole = checked.filter(exists & ~has_path).join(
        trees.select("repo_full_name", F.lit(True).alias("_tree"), cut.alias("_cut")), "repo_full_name", "left"
    )
    # one row per repository, so the tree side can be split freely
    scanned = whole.filter(F.col("_tree")).select("repo_full_name", "default_branch", "n_requests", F.col("_cut").alias("seen_in_part"))
    blobs = manifest_blobs(tree).select("repo_full_name", F.col("path").alias("skill_path"))
    expanded = lookup_join(blobs, scanned, ["repo_full_name"], ["skill_path"], busy_tree, how="inner")

    columns = ["repo_full_name", "skill_path", "default_branch", "n_requests"]
    # a file may be asked for by itself and with its whole repository
    wanted = single.select(*columns, F.lit(False).alias("seen_in_part")).unionByName(expanded.select(*columns, "seen_in_part"))
    marks = [F.bool_or("seen_in_part").alias("seen_in_part")] if "truncated" in trees.columns else []
    wanted = wanted.groupBy("repo_full_name", "skill_path", "default_branch").agg(F.sum("n_requests").alias("n_requests"), *marks)
    files = with_addresses(wanted, SOURCE)

    wrong_path = has_path & ~refs.is_manifest_path(F.col("skill_path"))
    failures = checked.filter(~exists | wrong_path).select(*columns)
    no_tree = whole.filter(F.col("_tree").isNull()).select(*columns)
    return files, failures.unionByName(no_tree)


def submit_dispositions(
    submissions: DataFrame,
    tree: DataFrame,
    contents: DataFrame,
    repos: DataFrame,
    layout: DataFrame,
    as_of: Column,
    rules=DEFAULT_RULES,
    trees: DataFrame | None = None,
) -> DataFrame:
    read = tree.select("repo_full_name").distinct() if trees is None else trees
    # Everything after the parse is as small as the distinct targets and the files they name.
    asked = stage(targets(submissions), "targets")
    [busy] = busy_keys(asked, ["repo_full_name"])
    blobs = stage(manifest_blobs(tree).distinct(), "manifests")
    [busy_tree] = busy_keys(blobs, ["repo_full_name"])
    files, failures = resolve(asked, repos, blobs, read, busy, busy_tree)
    files = stage(files, "files")
    built = build_records(files, contents, repos, layout, as_of, rules, busy_candidates(files))
    failed = failures.withColumn("source_type", F.lit(SOURCE))
    return stage(built.unionByName(count_only(failed, built, "failed", failed=F.col("n_requests"))), "dispositions")
