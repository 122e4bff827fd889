"""S: sources and sinks.  O: fetch outcomes."""

from datetime import datetime

from pyspark.sql import functions as F

from catalog_queries import landed
from catalog_queries import sqltext as q
from catalog_queries.registry import as_of, bits, query, text_time
from shelfmark import schemas
from shelfmark.functions.coerce import to_record
from shelfmark.session import new_shared_path
from shelfmark.sources import index_store, known_repos, landing, outcomes

AS_OF = datetime(2024, 3, 1)

KEPT_HITS = """kept AS (
  SELECT h.*, p.status_code, row_number() OVER (PARTITION BY h.query_idx, h.page ORDER BY h.pos) - 1 AS place
  FROM search_hits h JOIN search_pages p ON p.query_idx = h.query_idx AND p.page = h.page
  WHERE p.n_items > 0 AND p.status_code = 200
)"""


@query(
    "s1_search_hits",
    f"""WITH {KEPT_HITS}
SELECT query_idx, page, place AS pos, repo_full_name, 'https://github.com/' || repo_full_name AS repo_url,
  split_part(repo_full_name, '/', 1) AS repo_owner, 'main' AS default_branch, skill_path, html_url, api_url FROM kept""",
)
def _(i):
    path = new_shared_path(i.spark, "search-landing")
    landed.search_responses(i).write.json(path)
    responses = landing.read_responses(i.spark, path, schemas.SEARCH_LANDING)
    return landing.search_hits(landing.search_pages(responses))


@query(
    "s2_file_contents",
    """SELECT doc_id, api_url, status_code, etag, md5(CASE WHEN status_code = 200 THEN content ELSE '' END) AS text_hash,
  length(CASE WHEN status_code = 200 THEN content ELSE '' END) AS text_length, CASE WHEN status_code = 200 THEN sha END AS sha,
  CASE WHEN status_code = 200 THEN size END AS size, CASE WHEN status_code = 200 THEN 'https://raw.example/' || sha END AS download_url
FROM content_responses""",
)
def _(i):
    files = landing.file_contents(landed.content_responses(i))
    return files.select(
        "doc_id", "api_url", "status_code", "etag", F.md5("content").alias("text_hash"),
        F.length("content").alias("text_length"), "sha", "size", "download_url",
    )


@query(
    "s3_repo_stats",
    f"""SELECT repo_full_name, stars, forks, 0 AS watchers, 0 AS open_issues, repo_license, repo_default_branch, CAST(archived AS INT) AS archived,
  0 AS disabled, 0 AS private, {q.ts("CAST(replace(replace(updated_at, 'T', ' '), 'Z', '') AS TIMESTAMP)")} AS repo_updated_at FROM repos""",
)
def _(i):
    r = landing.repo_stats(landed.repo_responses(i))
    return r.select(
        "repo_full_name", "stars", "forks", "watchers", "open_issues", "repo_license", "repo_default_branch",
        *bits("archived", "disabled", "private"), text_time("repo_updated_at"),
    )


@query("s4_tree_items", "SELECT repo_full_name, path, type FROM tree_items")
def _(i):
    return landing.tree_items(landed.tree_responses(i)).select("repo_full_name", "path", "type")


@query(
    "s4_trees_read",
    r"""SELECT repo_full_name, CAST(bool_or(suffix(regexp_extract(path, '\A(skills/[^/]+)', 1), '7')) AS INT) AS truncated FROM tree_items GROUP BY repo_full_name""",
)
def _(i):
    return landing.trees_read(landed.tree_responses(i)).select("repo_full_name", *bits("truncated"))


@query("s5_listing_items", "SELECT repo_full_name, dir, name, type FROM listing_items WHERE doc_id % 19 <> 0")
def _(i):
    return landing.listing_items(landed.listing_responses(i))


@query("s6_snapshot", "SELECT id, name, repo_full_name, skill_path, skill_sha, stars, status, risk_level FROM skill_index")
def _(i):
    store = index_store.IndexStore(i.spark, new_shared_path(i.spark, "index"), buckets=8)
    store.publish(i.skill_index, AS_OF)
    return store.read().select("id", "name", "repo_full_name", "skill_path", "skill_sha", "stars", "status", "risk_level")


@query(
    "s7_seed_known_repos",
    """SELECT 'filled' AS table_state, repo_full_name, source_level, scan_enabled FROM known_repos
UNION ALL SELECT 'empty', 'anthropics/anthropic-quickstarts', 'official', 1
UNION ALL SELECT 'empty', 'modelcontextprotocol/servers', 'trusted', 1""",
)
def _(i):
    known = i.known_repos
    nobody = known.filter(F.col("source_level") == "unlisted")
    columns = ["repo_full_name", "source_level", F.col("scan_enabled").cast("int").alias("scan_enabled")]
    filled = known_repos.with_seeds(known, as_of()).select(F.lit("filled").alias("table_state"), *columns)
    seeded = known_repos.with_seeds(nobody, as_of()).select(F.lit("empty").alias("table_state"), *columns)
    return filled.unionByName(seeded)


_EXPORTED = f"""SELECT repo_full_name, skill_path, name, stars, '["a","b"]' AS risk_flags, {q.ts('last_checked_at')} AS last_checked_at FROM skill_index"""


def _export_frame(i):
    flags = F.array(F.lit("a"), F.lit("b"))
    return i.skill_index.select("repo_full_name", "skill_path", "name", "stars", flags.alias("risk_flags"), "last_checked_at")


@query("s8_export_csv", _EXPORTED)
def _(i):
    rows, path = _export_frame(i), new_shared_path(i.spark, "export-csv")
    index_store.export_csv(rows, path)
    flat = schemas.struct(**{f.name: schemas.STRING if f.name == "risk_flags" else f.dataType for f in rows.schema.fields})
    return index_store.read_csv(i.spark, path, flat).withColumn("last_checked_at", text_time("last_checked_at"))


@query("s8_export_json", _EXPORTED)
def _(i):
    rows, path = _export_frame(i), new_shared_path(i.spark, "export-json")
    index_store.export_json(rows, path)
    back = i.spark.read.schema(rows.schema).json(path)
    return back.withColumns({"last_checked_at": text_time("last_checked_at"), "risk_flags": F.to_json("risk_flags")})


# ---------------------------------------------------------------- outcomes
@query("o1_outcomes", f"SELECT event_id, {q.OUTCOME} AS outcome FROM fetch_log")
def _(i):
    return i.fetch_log.select("event_id", outcomes.outcome(F.col("status_code"), F.col("body")).alias("outcome"))


@query(
    "o2_final_outcomes",
    f"""WITH a AS (SELECT request_id, attempt, {q.OUTCOME} AS outcome FROM fetch_log WHERE attempt <= 3),
cut AS (SELECT *, min(CASE WHEN outcome IN ('ok', 'not_modified', 'not_found', 'auth_error') THEN attempt END) OVER (PARTITION BY request_id) AS stop FROM a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) AS rn FROM cut WHERE stop IS NULL OR attempt <= stop)
SELECT request_id, outcome, attempt AS n_attempts FROM ranked WHERE rn = 1""",
)
def _(i):
    log = i.fetch_log.withColumn("outcome", outcomes.outcome(F.col("status_code"), F.col("body")))
    return outcomes.final_outcomes(log, ["request_id"])


@query(
    "o3_rate_budget",
    """SELECT event_id, CASE WHEN remaining < 10 AND reset > "at" THEN reset - "at" + 1 ELSE 0 END AS wait_seconds FROM fetch_log""",
)
def _(i):
    return outcomes.rate_budget(i.fetch_log).select("event_id", "wait_seconds")
