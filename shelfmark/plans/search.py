"""Acquisition from search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.risk import DEFAULT_RULES
from shelfmark.operators import dedup
from shelfmark.plans.records import build_records, busy_candidates, count_only
from shelfmark.session import stage
from shelfmark.sources import landing

SOURCE = "github_search"


def candidates(hits: DataFrame) -> DataFrame:
    """First hit of every file; ``n_repeats`` later ones are skipped."""
    firsts = dedup.first_seen(hits.filter(dedup.has_required_fields()))
    return firsts.select(
        "repo_full_name",
        "skill_path",
        F.col("html_url").alias("skill_html_url"),
        F.col("api_url").alias("skill_api_url"),
        "repo_owner",
        "repo_url",
        "default_branch",
        F.lit(SOURCE).alias("source_type"),
        (F.col("n_seen") - 1).alias("n_repeats"),
        *dedup.ARRIVAL,
    )


def search_dispositions(
    pages: DataFrame, contents: DataFrame, repos: DataFrame, layout: DataFrame, as_of: Column, rules=DEFAULT_RULES
) -> DataFrame:
    """Every candidate of the landed pages with its record or the reason there is none.

    Duplicates go before any content is touched, and only their number survives.
    """
    # parsed once: the stops, the sketch, the candidates and the rejects all read this
    hits = landing.search_hits(dedup.readable_pages(stage(pages, "pages")))
    keys = hits.select("repo_full_name", "skill_path", F.col("api_url").alias("skill_api_url"))
    built = build_records(candidates(hits), contents, repos, layout, as_of, rules, busy_candidates(keys))
    rejected = hits.filter(~dedup.has_required_fields()).groupBy(F.lit(SOURCE).alias("source_type"))
    without_fields = count_only(rejected.agg(F.count("*").alias("n")), built, "rejected", failed=F.col("n"))
    return stage(built.unionByName(without_fields), "dispositions")
