"""Landed API responses derived from the views: one raw JSON body per row."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_queries.views import LANDED, VIEWS, Inputs

RESPONSES: dict[str, Callable[[Inputs], DataFrame]] = {}


def _landed(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    name = f"landed_{build.__name__}"
    RESPONSES[name] = build
    return functools.wraps(build)(lambda inputs: inputs.landed(name, lambda: build(inputs)))


def land(spark: SparkSession, sf_dir: str, root: str, files: int) -> None:
    """Write every view and every kind of response once; queries over ``sf_dir`` read those files from then on."""
    inputs = Inputs(spark, sf_dir)
    for name in VIEWS:
        getattr(inputs, name).repartition(files).write.parquet(f"{root}/{name}")
    for name, build in RESPONSES.items():
        build(inputs).repartition(files).write.parquet(f"{root}/{name}")
    LANDED[sf_dir] = root


@_landed
def search_responses(inputs: Inputs) -> DataFrame:
    """One response per page of at most 50 hits; some pages failed, some are empty."""
    pages = inputs.search_pages
    item = F.struct(
        "pos",
        F.struct(
            F.lit("SKILL.md").alias("name"),
            F.col("skill_path").alias("path"),
            "html_url",
            F.col("api_url").alias("url"),
            F.struct(
                F.col("repo_full_name").alias("full_name"),
                F.concat(F.lit("https://github.com/"), "repo_full_name").alias("html_url"),
                F.struct(F.split_part("repo_full_name", F.lit("/"), F.lit(1)).alias("login")).alias("owner"),
            ).alias("repository"),
        ).alias("item"),
    )
    per_page = inputs.search_hits.groupBy("query_idx", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    full = pages.join(per_page, ["query_idx", "page"])
    kept = F.when(F.col("n_items") > 0, F.col("items.item")).otherwise(F.expr("filter(items.item, x -> false)"))
    body = F.to_json(F.struct(F.col("n_items").alias("total_count"), kept.alias("items")))
    return full.select("query_idx", "page", "status_code", body.alias("payload"))


@_landed
def content_responses(inputs: Inputs) -> DataFrame:
    body = F.struct(
        F.base64(F.col("content").cast("binary")).alias("content"),
        F.lit("base64").alias("encoding"),
        "sha",
        "size",
        F.concat(F.lit("https://raw.example/"), "sha").alias("download_url"),
    )
    return inputs.content_responses.select(
        "doc_id", "api_url", "status_code", "body", "etag", F.lit("Mon, 01 Jan 2024 06:00:00 GMT").alias("last_modified"),
        F.to_json(body).alias("payload"),
    )


@_landed
def repo_responses(inputs: Inputs) -> DataFrame:
    body = F.struct(
        F.col("stars").alias("stargazers_count"),
        F.col("forks").alias("forks_count"),
        F.struct("spdx_id").alias("license"),
        "default_branch",
        "archived",
        "updated_at",
    )
    return inputs.repo_responses.select("repo_full_name", "status_code", F.lit("").alias("body"), F.to_json(body).alias("payload"))


@_landed
def tree_responses(inputs: Inputs) -> DataFrame:
    """One response per repository subtree (the part below one directory); a tenth are marked as truncated."""
    folder = F.regexp_extract("path", r"\A(skills/[^/]+)", 1)
    entry, cut = F.struct("path", "type"), F.col("folder").endswith("7")
    grouped = inputs.tree_items.groupBy("repo_full_name", folder.alias("folder")).agg(F.collect_list(entry).alias("tree"))
    return grouped.select("repo_full_name", F.lit(200).alias("status_code"), F.to_json(F.struct("tree", cut.alias("truncated"))).alias("payload"))


@_landed
def listing_responses(inputs: Inputs) -> DataFrame:
    """One response per directory; a nineteenth are a lone object, as for a file."""
    items = inputs.listing_items.groupBy("doc_id", "repo_full_name", "dir").agg(
        F.collect_list(F.struct("name", "type")).alias("items")
    )
    lone = F.to_json(F.get("items", F.lit(0)))
    payload = F.when(F.col("doc_id") % 19 == 0, lone).otherwise(F.to_json("items"))
    return items.select("repo_full_name", "dir", F.lit(200).alias("status_code"), payload.alias("payload"))
