"""Landed API responses to rows.

Each reader takes a frame with one response per row and the raw body in
``payload``; ``read_responses`` loads such frames from JSON-lines files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas
from shelfmark.fixed_values import DEFAULT_BRANCH, SEARCH_QUERIES
from shelfmark.functions.coerce import iso_timestamp
from shelfmark.functions.text import blank_to_null


def read_responses(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _ok() -> Column:
    return F.col("status_code").between(200, 299)


def search_pages(responses: DataFrame) -> DataFrame:
    """One row per landed page with its parsed items and their number."""
    body = F.from_json("payload", schemas.SEARCH_PAYLOAD)
    return responses.select(
        "query_idx", "page", "status_code", body.getField("items").alias("items")
    ).withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)))


def query_text(query_idx: Column, queries: list[str] = SEARCH_QUERIES) -> Column:
    """The text of a search query by its number (from 1); the queries are configuration."""
    return F.get(F.array(*[F.lit(q) for q in queries]), query_idx - 1)


def search_hits(pages: DataFrame) -> DataFrame:
    """One row per search item, placed by (query_idx, page, pos); empty pages give none."""
    hits = pages.filter(_ok()).select("query_idx", "page", F.posexplode("items").alias("pos", "item"))
    repo = F.col("item.repository")
    return hits.select(
        "query_idx",
        "page",
        "pos",
        repo.getField("full_name").alias("repo_full_name"),
        repo.getField("html_url").alias("repo_url"),
        repo.getField("owner").getField("login").alias("repo_owner"),
        F.coalesce(repo.getField("default_branch"), F.lit(DEFAULT_BRANCH)).alias("default_branch"),
        F.col("item.path").alias("skill_path"),
        F.col("item.html_url").alias("html_url"),
        F.col("item.url").alias("api_url"),
    )


def decode_base64(df: DataFrame, content: Column, encoding: Column) -> DataFrame:
    """Add ``content``: base64 to text, without bytes that are not UTF-8, empty when undecodable.

    Characters outside the alphabet are ignored and missing padding is an error, as
    for a lenient decoder; Spark's own decoder differs in both.  The usual case,
    clean and padded, never reaches the regular expression.
    """
    stripped = F.regexp_replace("_b64", r"[^A-Za-z0-9+/=]", "")
    decoded = F.coalesce(F.try_to_binary("_b64", F.lit("base64")), F.try_to_binary(stripped, F.lit("base64")))
    tail, over = F.rtrim(F.col("_b64"), F.lit("\r\n ")), F.octet_length("_bytes") % 3
    padded = F.when(over == 0, True).when(over == 1, tail.endswith("==")).otherwise(tail.endswith("="))
    raw = F.col("_raw")
    # U+FFFD marks what was invalid, so one that the text itself holds steps aside meanwhile: U+FDD0 is
    # written as U+FDD0 0 and U+FFFD as U+FDD0 1, which can be told apart again
    spare, bad = "\ufdd0", "\ufffd"
    aside = F.replace(F.replace(raw, F.lit(spare), F.lit(spare + "0")), F.lit(bad), F.lit(spare + "1"))
    cleaned = F.replace(F.make_valid_utf8(aside), F.lit(bad), F.lit(""))
    back = F.replace(F.replace(cleaned, F.lit(spare + "1"), F.lit(bad)), F.lit(spare + "0"), F.lit(spare))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(back)
    return (
        df.withColumn("_b64", F.when(encoding == "base64", content))
        .withColumn("_bytes", decoded)
        .withColumn("_raw", F.when(padded | (F.length(stripped) % 4 == 0), F.col("_bytes").cast("string")))
        .withColumn("content", F.coalesce(text, F.lit("")))
        .drop("_b64", "_bytes", "_raw")
    )


def file_contents(responses: DataFrame) -> DataFrame:
    """Decoded file per response; the text is empty unless the response was a success."""
    body = F.from_json("payload", schemas.CONTENT_PAYLOAD)
    keys = [c for c in responses.columns if c != "payload"]
    parsed = responses.select(*keys, F.when(_ok(), body).alias("p"))
    decoded = decode_base64(parsed, F.col("p.content"), F.col("p.encoding"))
    return decoded.select(*keys, "content", "p.sha", "p.size", "p.download_url")


def repo_stats(responses: DataFrame) -> DataFrame:
    """Renamed and defaulted statistics of every repository that answered."""
    p = F.from_json("payload", schemas.REPO_PAYLOAD)
    parsed = responses.filter(_ok()).select("repo_full_name", p.alias("p"))

    def count(name: str) -> Column:
        return F.coalesce(F.col(f"p.{name}"), F.lit(0))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"p.{name}"), F.lit(False))

    return parsed.select(
        "repo_full_name",
        count("stargazers_count").alias("stars"),
        count("forks_count").alias("forks"),
        count("watchers_count").alias("watchers"),
        count("open_issues_count").alias("open_issues"),
        F.coalesce(F.col("p.license.spdx_id"), F.lit("")).alias("repo_license"),
        F.coalesce(blank_to_null(F.col("p.default_branch")), F.lit(DEFAULT_BRANCH)).alias("repo_default_branch"),
        flag("archived").alias("archived"),
        flag("disabled").alias("disabled"),
        flag("private").alias("private"),
        iso_timestamp(F.col("p.updated_at")).alias("repo_updated_at"),
        iso_timestamp(F.col("p.pushed_at")).alias("repo_pushed_at"),
    )


def tree_items(responses: DataFrame) -> DataFrame:
    """One row per entry of a recursive tree."""
    tree = F.from_json("payload", schemas.TREE_PAYLOAD).getField("tree")
    return responses.filter(_ok()).select("repo_full_name", F.inline(tree))


def trees_read(responses: DataFrame) -> DataFrame:
    """One row per repository whose tree was read: ``truncated`` says that an answer left entries out."""
    cut = F.coalesce(F.from_json("payload", schemas.TREE_PAYLOAD).getField("truncated"), F.lit(False))
    return responses.filter(_ok()).groupBy("repo_full_name").agg(F.bool_or(cut).alias("truncated"))


def listing_items(responses: DataFrame) -> DataFrame:
    """One row per entry of a directory listing; a body that is not an array gives none."""
    # from_json would wrap a lone object into a one-element array
    is_array = F.ltrim(F.col("payload")).startswith("[")
    items = F.from_json("payload", schemas.LISTING_PAYLOAD)
    return responses.filter(_ok()).select("repo_full_name", "dir", F.inline(F.when(is_array, items)))
