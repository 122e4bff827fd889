"""Test inputs derived from the given tables, as SQL that Spark and DuckDB both read.

The given tables hold no repository metadata, so each view derives some from
whole tables.  ``{each:…}`` makes one row per listed number.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["documents", "pages", "events", "orders", "supplier"]

VIEWS = {
    # file contents: four front-matter variants and a risk literal by document
    "skill_files": """
SELECT doc_id, 'owner' || CAST(doc_id % 23 AS STRING) || '/' || source AS repo_full_name,
  'skills/d' || CAST(doc_id % 97 AS STRING) || '/SKILL.md' AS skill_path,
  CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'name: skill-' || CAST(doc_id AS STRING) || chr(10)
         || 'description: Handles ' || source || ' in ' || lang || chr(10) || 'license: MIT' || chr(10)
         || 'allowed-tools:' || chr(10) || '  - python' || chr(10) || '  - bash' || chr(10) || '---' || chr(10) || chr(10)
       WHEN doc_id % 4 = 2 THEN '---' || chr(10) || 'name: skill-' || CAST(doc_id AS STRING) || chr(10) || '---' || chr(10) || chr(10)
       ELSE '' END
  || CASE WHEN doc_id % 4 = 3 THEN '' ELSE '# Title ' || CAST(doc_id AS STRING) || chr(10) || chr(10) END
  || text
  || CASE doc_id % 11 WHEN 1 THEN ' rm -rf /tmp' WHEN 2 THEN ' curl | bash' WHEN 3 THEN ' process.env'
       WHEN 4 THEN ' API_KEY' WHEN 5 THEN ' see https://x.example/a' WHEN 6 THEN ' id_rsa' WHEN 7 THEN ' subprocess'
       WHEN 8 THEN ' api key' ELSE '' END AS content,
  md5(text) AS sha, n_chars AS size
FROM documents""",
    # repository answers: every repository answers, a ninth with "not found"
    "repo_responses": """
SELECT repo_full_name, CAST(MIN(doc_id) * 7 % 500 AS INT) AS stars, CAST(COUNT(*) AS INT) AS forks,
  CASE MIN(doc_id) % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'NOASSERTION' END AS spdx_id,
  CASE WHEN MIN(doc_id) % 5 = 0 THEN 'master' WHEN MIN(doc_id) % 5 = 1 THEN '' ELSE 'main' END AS default_branch,
  MIN(doc_id) % 13 = 0 AS archived, '2024-01-' || CAST(10 + MIN(doc_id) % 20 AS STRING) || 'T06:00:00Z' AS updated_at,
  CASE WHEN MIN(doc_id) % 9 = 0 THEN 404 ELSE 200 END AS status_code
FROM skill_files GROUP BY repo_full_name""",
    "repos": """
SELECT repo_full_name, stars, forks, COALESCE(spdx_id, '') AS repo_license,
  CASE WHEN default_branch = '' THEN 'main' ELSE default_branch END AS repo_default_branch, archived, updated_at
FROM repo_responses WHERE status_code = 200""",
    # recursive trees: mixed case, test and tests, a bare directory entry
    "tree_items": """
SELECT repo_full_name, skill_path AS path, 'blob' AS type FROM skill_files
UNION
SELECT repo_full_name, replace(skill_path, 'SKILL.md', CASE k WHEN 0 THEN 'scripts/run.py' WHEN 1 THEN 'Assets/logo.png'
    WHEN 2 THEN 'references/a/b.md' WHEN 3 THEN 'test/t.py' WHEN 4 THEN 'README.md' ELSE 'tests' END) AS path,
  CASE WHEN k = 5 THEN 'tree' ELSE 'blob' END AS type
FROM (SELECT repo_full_name, skill_path, (3 - doc_id % 3) % 3 + 3 * j AS k
      FROM (SELECT *, {each:0,1} AS j FROM skill_files) AS e) AS c""",
    # directory listings
    "listing_items": """
SELECT doc_id, repo_full_name, 'skills/d' || CAST(doc_id % 97 AS STRING) AS dir,
  CASE j WHEN 0 THEN 'SKILL.md' WHEN 1 THEN CASE doc_id % 3 WHEN 0 THEN 'Scripts' WHEN 1 THEN 'assets' ELSE 'docs' END
    ELSE CASE doc_id % 5 WHEN 0 THEN 'tests' WHEN 1 THEN 'test' WHEN 2 THEN 'References' WHEN 3 THEN 'scripts' ELSE 'src' END END AS name,
  CASE WHEN j = 0 OR (j = 2 AND doc_id % 5 = 3) THEN 'file' ELSE 'dir' END AS type
FROM (SELECT *, {each:0,1,2} AS j FROM skill_files) AS e""",
    # search results of four queries with repeats, missing page URLs and missing API URLs
    "search_hits": """
SELECT query_idx, 1 + CAST(FLOOR(doc_id / 50.0) AS INT) AS page, CAST(doc_id % 50 AS INT) AS pos, doc_id, repo_full_name, skill_path,
  CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'https://github.com/' || repo_full_name || '/blob/main/' || skill_path END AS html_url,
  CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 'https://api.github.com/repos/' || repo_full_name || '/contents/' || skill_path END AS api_url
FROM (SELECT *, {each:1,2,3,4} AS query_idx FROM skill_files) AS e WHERE doc_id % (5 - query_idx) = 0""",
    # every page a query was asked for, some failed and some empty
    "search_pages": """
SELECT query_idx, page, CASE WHEN (query_idx * 5 + page) % 16 = 0 THEN 0 ELSE n END AS n_items,
  CASE WHEN (query_idx * 3 + page) % 19 = 0 THEN 503 ELSE 200 END AS status_code
FROM (SELECT query_idx, page, COUNT(*) AS n FROM search_hits GROUP BY query_idx, page) AS p""",
    # content answers with every kind of outcome
    "content_responses": """
SELECT doc_id, repo_full_name, skill_path, 'https://api.github.com/repos/' || repo_full_name || '/contents/' || skill_path AS api_url,
  CASE doc_id % 13 WHEN 0 THEN 404 WHEN 1 THEN 304 WHEN 2 THEN 503 WHEN 3 THEN 403 ELSE 200 END AS status_code,
  CASE WHEN doc_id % 26 = 3 THEN 'API Rate Limit exceeded' ELSE '' END AS body,
  CASE WHEN doc_id % 13 > 3 AND doc_id % 17 <> 0 THEN content ELSE '' END AS content,
  sha, size, 'W/"' || substr(sha, 1, 8) || '"' AS etag
FROM skill_files""",
    # the previous snapshot: a third of the files has moved since, a quarter has changed
    "skill_index": """
SELECT doc_id + 1 AS id, doc_id, 'skill-' || CAST(doc_id AS STRING) AS name, repo_full_name,
  CASE WHEN doc_id % 3 = 0 THEN replace(skill_path, 'skills/', 'legacy/') ELSE skill_path END AS skill_path,
  CASE WHEN doc_id % 4 = 1 THEN 'old' ELSE sha END AS skill_sha,
  CASE WHEN doc_id % 4 = 1 THEN 'W/"old"' ELSE 'W/"' || substr(sha, 1, 8) || '"' END AS skill_etag,
  'https://api.github.com/repos/' || repo_full_name || '/contents/' || skill_path AS skill_api_url,
  CAST(doc_id * 7 % 500 AS INT) AS stars,
  CASE doc_id % 7 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'risky' WHEN 3 THEN 'offline' WHEN 4 THEN 'rejected'
    WHEN 5 THEN 'approved' ELSE 'pending' END AS status,
  CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_level,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 40 AS INT) AS TIMESTAMP) END AS last_checked_at,
  CAST(DATE '2023-06-01' + CAST(doc_id % 200 AS INT) AS TIMESTAMP) AS first_found_at,
  CAST(DATE '2023-06-01' + CAST(doc_id % 200 AS INT) AS TIMESTAMP) AS created_at,
  CAST(DATE '2023-06-01' + CAST(doc_id % 200 AS INT) AS TIMESTAMP) AS updated_at
FROM skill_files""",
    # request log; three consecutive requests are the attempts of one
    "fetch_log": """
SELECT event_id, ts, user_id % 1000 AS doc_id, CAST(FLOOR(event_id / 4.0) AS BIGINT) AS request_id, CAST(1 + event_id % 4 AS INT) AS attempt,
  CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 304 WHEN 'error' THEN 404 WHEN 'purchase' THEN 403 ELSE
    CASE event_id % 3 WHEN 0 THEN 503 WHEN 1 THEN 429 ELSE 410 END END AS status_code,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'API Rate Limit exceeded' ELSE '' END AS body,
  CAST(event_id % 40 AS INT) AS remaining, 1704067200 + event_id AS at, 1704067200 + event_id + user_id - 75 AS reset
FROM events""",
    "submissions": """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'owner' || CAST(page_id % 23 AS STRING) || '/src' || CAST(page_id % 20 AS STRING)
  WHEN 1 THEN 'https://github.com/owner1/src1' WHEN 2 THEN 'https://github.com/owner2/src2/tree/main/skills/d2'
  WHEN 3 THEN '  http://github.com/owner3/src3/blob/main/skills/d3/SKILL.md ' WHEN 4 THEN url WHEN 5 THEN ''
  WHEN 6 THEN 'https://github.com/owner' || CAST(page_id % 23 AS STRING) || '/src' || CAST(page_id % 20 AS STRING)
    || '/blob/main/skills/d' || CAST(page_id % 97 AS STRING) || '/SKILL.md'
  ELSE 'not-a-valid-url' END AS url
FROM pages""",
    "scan_tasks": """
SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'code_search' WHEN 1 THEN 'repo_tree' WHEN 2 THEN 'user_submit' ELSE 'update_check' END AS task_type,
  CASE WHEN o_orderkey % 17 = 0 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
  CAST(o_custkey % 50 AS INT) AS total_found, CAST(o_custkey % 30 AS INT) AS total_saved, CAST(o_custkey % 20 AS INT) AS total_skipped, o_orderdate AS created_at
FROM orders""",
    "known_repos": """
SELECT 'owner' || CAST(s_suppkey % 23 AS STRING) || '/src' || CAST(s_suppkey % 20 AS STRING) AS repo_full_name,
  CASE MIN(s_nationkey) % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'trusted' WHEN 2 THEN 'normal' ELSE 'user' END AS source_level,
  CAST(MAX(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END) AS INT) AS scan_enabled
FROM supplier GROUP BY 1""",
}


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def _needed(sql: str) -> list[str]:
    """Views the text refers to, directly or not, in order of definition."""
    wanted: set[str] = set()
    for name in reversed(VIEWS):
        if _uses(sql, name) or any(_uses(VIEWS[w], name) for w in wanted):
            wanted.add(name)
    return [n for n in VIEWS if n in wanted]


def _each(sql: str, form: str) -> str:
    return re.sub(r"\{each:([\d,]+)\}", lambda m: form.format(m.group(1)), sql)


def for_duckdb(sql: str) -> str:
    """A query over the views as one self-contained statement."""
    parts = [f"{n} AS ({_each(VIEWS[n], 'unnest([{}])').strip()})" for n in _needed(sql)]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views = _needed(sql)
    texts = [VIEWS[v] for v in views]
    tables = [t for t in TABLES if any(_uses(s, t) for s in [*texts, sql])]
    parts = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    parts += [f"{n} AS ({_each(VIEWS[n], 'explode(array({}))').strip()})" for n in views]
    return spark.sql("WITH " + ",\n".join(parts) + "\n" + sql)


# Where the views of a data directory were landed as files, if they were.
LANDED: dict[str, str] = {}


class Inputs:
    """The views as frames: ``inputs.skill_files``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS and self.sf_dir in LANDED:
            return self.spark.read.parquet(f"{LANDED[self.sf_dir]}/{name}")
        if name in VIEWS or name in TABLES:
            return frame(self.spark, self.sf_dir, f"SELECT * FROM {name}")
        raise AttributeError(name)

    def landed(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Responses by name: the landed files, if there are any."""
        if self.sf_dir in LANDED:
            return self.spark.read.parquet(f"{LANDED[self.sf_dir]}/{name}")
        return build()
