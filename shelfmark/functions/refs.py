"""Paths, addresses and repository references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.fixed_values import API, FILE_URL_PATTERN, MANIFEST_SUFFIX, RAW, REPOSITORY_URL_PATTERN, SITE, SUBMITTED_SUFFIXES
from shelfmark.functions.text import blank_to_null, strip

_REPO, _FILE = REPOSITORY_URL_PATTERN, FILE_URL_PATTERN


def skill_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def raw_url(repo: Column, branch: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{RAW}/"), repo, F.lit("/"), branch, F.lit("/"), path)


def page_url(repo: Column, branch: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/"), repo, F.lit("/blob/"), branch, F.lit("/"), path)


def contents_api_url(repo: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{API}/repos/"), repo, F.lit("/contents/"), path)


def repo_url(repo: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/"), repo)


def repo_owner(repo: Column) -> Column:
    return F.split_part(repo, F.lit("/"), F.lit(1))


def repo_name(repo: Column) -> Column:
    """Second segment of ``owner/name``, empty without a slash."""
    return F.split_part(repo, F.lit("/"), F.lit(2))


def is_manifest_blob(path: Column, kind: Column) -> Column:
    return F.coalesce(path.endswith(MANIFEST_SUFFIX) & (kind == "blob"), F.lit(False))


def is_manifest_path(path: Column) -> Column:
    return F.coalesce(reduce(Column.__or__, [path.endswith(s) for s in SUBMITTED_SUFFIXES]), F.lit(False))


def _is_short(ref: Column) -> Column:
    one_slash = F.length(ref) - F.length(F.replace(ref, F.lit("/"), F.lit(""))) == 1
    return one_slash & ~F.contains(ref, F.lit("github.com"))


def parse_reference(ref: Column) -> Column:
    """``owner/repo`` or a repository, tree or blob address to its parts; NULL otherwise."""
    r = strip(ref)
    no_text = F.lit(None).cast("string")
    as_short = F.struct(
        repo_owner(r).alias("owner"), repo_name(r).alias("repo"), no_text.alias("branch"), no_text.alias("skill_path")
    )
    as_url = F.struct(
        F.regexp_extract(r, _REPO, 1).alias("owner"),
        F.regexp_extract(r, _REPO, 2).alias("repo"),
        blank_to_null(F.regexp_extract(r, _FILE, 1)).alias("branch"),
        blank_to_null(F.regexp_extract(r, _FILE, 2)).alias("skill_path"),
    )
    return F.when(_is_short(r), as_short).when(r.rlike(_REPO), as_url)


def referenced_repo(ref: Column) -> Column:
    """``owner/repo`` of a reference in one step; NULL when unreadable or incomplete."""
    r = strip(ref)
    url_repo = F.regexp_extract(r, r"\Ahttps?://github\.com/([^/]+/[^/]+)", 1)
    found = F.when(_is_short(r), F.regexp_extract(r, r"\A([^/]+/[^/]+)\z", 1)).otherwise(url_repo)
    return blank_to_null(found)


def referenced_path(ref: Column) -> Column:
    """File path inside a tree or blob address, NULL without one."""
    return blank_to_null(F.regexp_extract(strip(ref), _FILE, 2))


def full_name(owner: Column, repo: Column) -> Column:
    """``owner/repo``; empty when either part is."""
    both = (F.coalesce(owner, F.lit("")) != "") & (F.coalesce(repo, F.lit("")) != "")
    return F.when(both, F.concat(owner, F.lit("/"), repo)).otherwise(F.lit(""))
