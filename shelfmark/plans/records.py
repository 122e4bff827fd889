"""Candidates and landed content to index records.

Text is parsed and scanned where it is read and then dropped: joins move a
narrow row per file, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.functions import refs
from shelfmark.functions.coerce import flag01, to_record
from shelfmark.functions.frontmatter import parse_metadata
from shelfmark.functions.risk import DEFAULT_RULES, content_flags, risk_flags, risk_level
from shelfmark.operators.dedup import one_row_per
from shelfmark.operators.layout import attach_flags, place
from shelfmark.operators.skew import Busy, busy_keys, lookup_join
from shelfmark.sources.outcomes import final_attempts, outcome

CANDIDATE_COLUMNS = [
    "repo_full_name", "skill_path", "skill_html_url", "skill_api_url",
    "repo_owner", "repo_url", "default_branch", "source_type",
]


def parse_contents(contents: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Decoded responses to metadata and flags, one row per ``api_url``, without the text.

    Of several attempts the final one counts (``outcomes.final_attempts``); ``attempt`` is optional.
    """
    parsed = content_flags(parse_metadata(contents), rules=rules)
    attempt = F.col("attempt") if "attempt" in contents.columns else F.lit(1)
    narrow = parsed.select(
        F.col("api_url").alias("skill_api_url"),
        outcome(F.col("status_code"), F.col("body")).alias("outcome"),
        "meta",
        "content_flags",
        F.col("sha").alias("skill_sha"),
        F.col("size").cast("int").alias("skill_size"),
        F.col("etag").alias("skill_etag"),
        F.col("last_modified").alias("skill_last_modified"),
        attempt.cast("int").alias("_attempt"),
    )
    return final_attempts(narrow, ["skill_api_url"])


def busy_candidates(keys: DataFrame) -> tuple[Busy, ...]:
    """Busy join keys of candidates, from any cheap frame with their keys in like proportions."""
    placed = place(keys.select("repo_full_name", "skill_path", "skill_api_url"))
    return tuple(busy_keys(placed, ["skill_api_url"], ["repo_full_name"], ["repo_full_name", "dir"]))


def build_records(
    candidates: DataFrame,
    contents: DataFrame,
    repos: DataFrame,
    layout: DataFrame,
    as_of: Column,
    rules=DEFAULT_RULES,
    busy: tuple[Busy, Busy, Busy] | None = None,
) -> DataFrame:
    """One row per candidate: the record, its ``disposition`` and its four counts.

    The callers stage the result before they filter or count it: a filter on the
    disposition would otherwise be pushed below the parsing and repeat it.

    ``layout`` holds flags per (repository, directory).  ``busy`` comes from
    ``busy_candidates``; without it the joins are plain and adaptive execution alone
    deals with uneven keys.  Extra candidate columns pass through;
    ``n_requests`` weighs a candidate that stands for several requests and
    ``n_repeats`` adds duplicates that were dropped in its favour.
    """
    by_file, by_repo, by_dir = busy or (Busy(), Busy(), Busy())
    extra = [c for c in candidates.columns if c not in CANDIDATE_COLUMNS]
    stats = one_row_per(repos, ["repo_full_name"]).withColumn("_known", F.lit(True))

    # metadata joins last, so that its wider rows are shuffled once
    files = lookup_join(candidates, stats, ["repo_full_name"], ["skill_path", "skill_api_url"], by_repo)
    files = attach_flags(files, layout, by_dir)
    parsed = parse_contents(contents, rules)
    files = lookup_join(files, parsed, ["skill_api_url"], ["repo_full_name", "skill_path"], by_file)

    fetched = F.coalesce(F.col("outcome"), F.lit("missing"))
    disposition = (
        F.when(fetched == "not_modified", "skipped")
        .when((fetched == "ok") & F.col("meta").isNotNull(), "saved")
        .otherwise("failed")
    )
    branch = F.coalesce("repo_default_branch", "default_branch")
    repo, path = F.col("repo_full_name"), F.col("skill_path")
    flags = risk_flags(F.col("content_flags"), F.col("has_scripts"))
    shaped = files.withColumns(
        {
            "disposition": disposition,
            "name": F.col("meta.name"),
            "description": F.col("meta.description"),
            "license": F.col("meta.license"),
            "compatibility": F.col("meta.compatibility"),
            "allowed_tools": F.col("meta.allowed_tools"),
            "frontmatter_json": F.col("meta.frontmatter_json"),
            "repo_name": refs.repo_name(repo),
            "repo_default_branch": branch,
            "skill_dir": refs.skill_dir(path),
            "skill_raw_url": refs.raw_url(repo, branch, path),
            "repo_license": F.coalesce("repo_license", F.lit("")),
            "repo_archived": flag01(F.col("archived")),
            "repo_disabled": flag01(F.col("disabled")),
            "repo_private": flag01(F.col("private")),
            "risk_flags": flags,
            "risk_level": risk_level(flags),
            "status": F.lit("pending"),
        }
    )
    one = F.col("n_requests") if "n_requests" in extra else F.lit(1)
    repeats = F.col("n_repeats") if "n_repeats" in extra else F.lit(0)
    is_ = {d: F.when(F.col("disposition") == d, one).otherwise(F.lit(0)).cast("bigint") for d in ("saved", "skipped", "failed")}
    counts = {
        "n_found": one.cast("bigint"),
        "n_saved": is_["saved"],
        "n_skipped": is_["skipped"] + repeats,
        "n_failed": is_["failed"],
    }
    passed = ["disposition", *counts, *[c for c in extra if c not in ("n_requests", "n_repeats")]]
    counted = shaped.withColumns(counts)
    return to_record(counted, as_of, keep=passed)


def count_only(df: DataFrame, like: DataFrame, disposition: str, **counts: Column) -> DataFrame:
    """Rows of ``df`` that produce no record, shaped like dispositions so that counters see them."""
    zero = F.lit(0).cast("bigint")
    values = {
        "disposition": F.lit(disposition),
        **{f"n_{c}": counts.get(c, zero).cast("bigint") for c in ("found", "saved", "skipped", "failed")},
    }
    have = set(df.columns) | set(values)
    rows = df.withColumns(values)
    return rows.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    )


def saved_records(dispositions: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return dispositions.filter(F.col("disposition") == "saved").select(*schemas.RECORD_COLUMNS, *(extra or []))
