"""J: joins.  A: aggregations.  W: windows re-expressed.  U: set operations."""

from pyspark.sql import functions as F

from catalog_queries import landed
from catalog_queries import sqltext as q
from catalog_queries.landing import KEPT_HITS
from catalog_queries.registry import bits, query
from catalog_queries.scalars import REFERENCE
from shelfmark.functions import refs, risk
from shelfmark.operators import dedup, layout, ledger, merge, review
from shelfmark.operators.skew import busy_keys, lookup_join
from shelfmark.plans import scan, search, submit
from shelfmark.session import stage
from shelfmark.sources import known_repos, landing, outcomes

FLAG_BITS = ", ".join(f"CAST({f} AS INT) AS {f}" for f in layout.FLAGS)


@query(
    "j1_repo_stats",
    """SELECT doc_id, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks, coalesce(repo_license, '') AS repo_license,
  coalesce(repo_default_branch, 'main') AS branch, CAST(coalesce(archived, false) AS INT) AS archived
FROM skill_files f LEFT JOIN repos r ON f.repo_full_name = r.repo_full_name""",
)
def _(i):
    files = i.skill_files.select("doc_id", "repo_full_name", "skill_path")
    # a low threshold, so that the comparison covers salted keys at any size
    [busy] = busy_keys(files, ["repo_full_name"], at_least=4)
    joined = lookup_join(files, i.repos, ["repo_full_name"], ["skill_path"], busy)
    return joined.select(
        "doc_id",
        F.coalesce("stars", F.lit(0)).alias("stars"),
        F.coalesce("forks", F.lit(0)).alias("forks"),
        F.coalesce("repo_license", F.lit("")).alias("repo_license"),
        F.coalesce("repo_default_branch", F.lit("main")).alias("branch"),
        F.coalesce("archived", F.lit(False)).cast("int").alias("archived"),
    )


_LISTED = q.LISTED


@query(
    "j2_listing_flags",
    f"""WITH {_LISTED}
SELECT doc_id, {', '.join(f'CAST(coalesce({f}, false) AS INT) AS {f}' for f in layout.FLAGS)}
FROM skill_files f LEFT JOIN listed l ON l.repo_full_name = f.repo_full_name AND l.dir = regexp_replace(f.skill_path, '/[^/]*\\z', '')""",
)
def _(i):
    flags = layout.flags_from_listing(landing.listing_items(landed.listing_responses(i)))
    files = i.skill_files.select("doc_id", "repo_full_name", "skill_path")
    return layout.attach_flags(files, flags).select("doc_id", *bits(*layout.FLAGS))


@query("j3_tree_flags", f"WITH {q.LAYOUT} SELECT doc_id, {FLAG_BITS} FROM layout")
def _(i):
    files = i.skill_files.select("doc_id", "repo_full_name", "skill_path")
    return layout.attach_flags(files, layout.flags_from_tree(i.tree_items)).select("doc_id", *bits(*layout.FLAGS))


_CHANGES = """changes AS (
  SELECT coalesce(x.repo_full_name, c.repo_full_name) AS repo_full_name, coalesce(x.skill_path, c.skill_path) AS skill_path,
    CASE WHEN x.id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'gone'
      WHEN CASE WHEN c.doc_id % 10 = 0 THEN x.skill_sha = c.sha ELSE x.skill_etag = c.etag END THEN 'unchanged' ELSE 'modified' END AS change
  FROM skill_index x FULL JOIN content_responses c ON x.repo_full_name = c.repo_full_name AND x.skill_path = c.skill_path
)"""


@query("j4_change_classes", f"WITH {_CHANGES} SELECT repo_full_name, skill_path, change FROM changes")
def _(i):
    # a tenth of the answers has no validator, so that the hash decides
    etag = F.when(F.col("doc_id") % 10 != 0, F.col("etag"))
    current = i.content_responses.withColumn("skill_etag", etag).withColumnRenamed("sha", "skill_sha")
    return merge.change_classes(i.skill_index, current)


@query(
    "j5_scan_scope",
    """SELECT 'known' AS scope, t.repo_full_name, path FROM tree_items t WHERE t.repo_full_name IN (SELECT repo_full_name FROM known_repos WHERE scan_enabled = 1)
UNION ALL SELECT 'single', t.repo_full_name, path FROM tree_items t WHERE t.repo_full_name = 'owner1/src1'
UNION ALL SELECT 'default', t.repo_full_name, path FROM tree_items t WHERE t.repo_full_name IN ('anthropics/anthropic-quickstarts', 'modelcontextprotocol/servers')""",
)
def _(i):
    tree, known = i.tree_items, i.known_repos
    nobody = known.filter(F.col("source_level") == "unlisted")
    scopes = {
        "known": known_repos.scan_scope(known),
        "single": known_repos.scan_scope(known, "owner1/src1"),
        "default": known_repos.scan_scope(nobody),
    }
    [busy] = busy_keys(tree, ["repo_full_name"], at_least=4)
    parts = [
        lookup_join(tree, scope, ["repo_full_name"], ["path"], busy, how="left_semi").select(F.lit(n).alias("scope"), "repo_full_name", "path")
        for n, scope in scopes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "j6_submission_check",
    f"""WITH {REFERENCE}
SELECT page_id, CASE WHEN owner IS NULL THEN 'bad reference' WHEN owner || '/' || repo IN (SELECT repo_full_name FROM repos) THEN 'accepted' ELSE 'unknown repository' END AS verdict
FROM parts""",
)
def _(i):
    named = i.submissions.select("page_id", refs.referenced_repo(F.col("url")).alias("repo_full_name"))
    known = i.repos.select("repo_full_name", F.lit(True).alias("known"))
    [busy] = busy_keys(named, ["repo_full_name"], at_least=4)
    joined = lookup_join(named, known, ["repo_full_name"], ["page_id"], busy)
    verdict = (
        F.when(F.col("repo_full_name").isNull(), "bad reference").when(F.col("known"), "accepted").otherwise("unknown repository")
    )
    return joined.select("page_id", verdict.alias("verdict"))


FIRSTS = """firsts AS (
  SELECT *, coalesce(nullif(html_url, ''), repo_full_name || '/' || skill_path) AS hit_key,
    row_number() OVER (PARTITION BY coalesce(nullif(html_url, ''), repo_full_name || '/' || skill_path) ORDER BY query_idx, page, pos) AS rn
  FROM search_hits WHERE api_url IS NOT NULL
)"""


_ATTACHED = (
    f"""WITH {FIRSTS}, joined AS (
  SELECT f.hit_key, CASE WHEN c.api_url IS NULL THEN 'missing' ELSE {q.OUTCOME} END AS outcome,
    length(CASE WHEN c.status_code = 200 THEN c.content ELSE '' END) AS n_chars
  FROM firsts f LEFT JOIN content_responses c ON c.api_url = f.api_url WHERE rn = 1)
SELECT hit_key, outcome, n_chars, CAST(outcome = 'ok' AND n_chars > 0 AS INT) AS usable FROM joined"""
)


@query("j7_attach_content", _ATTACHED)
def _(i):
    candidates = dedup.first_seen(i.search_hits.filter(dedup.has_required_fields())).select("hit_key", "api_url")
    files = landing.file_contents(landed.content_responses(i)).select(
        "api_url", outcomes.outcome(F.col("status_code"), F.col("body")).alias("outcome"), F.length("content").alias("n_chars")
    )
    return _attached(candidates, files)


def _attached(candidates, files):
    [busy] = busy_keys(candidates, ["api_url"], at_least=4)
    joined = lookup_join(candidates, files, ["api_url"], ["hit_key"], busy)
    outcome = F.coalesce("outcome", F.lit("missing"))
    return joined.select(
        "hit_key", outcome.alias("outcome"), "n_chars",
        ((outcome == "ok") & (F.col("n_chars") > 0)).cast("int").alias("usable"),
    )


@query("j7_with_retries", _ATTACHED)
def _(i):
    """Every second request was answered by an error first, and a fifth of the answers landed twice."""
    candidates = dedup.first_seen(i.search_hits.filter(dedup.has_required_fields())).select("hit_key", "api_url")
    once = landed.content_responses(i).withColumn("attempt", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1))
    failed = once.filter("doc_id % 2 = 0").withColumns({"attempt": F.lit(1), "status_code": F.lit(503), "payload": F.lit("{}")})
    files = landing.file_contents(once.unionByName(failed).unionByName(once.filter("doc_id % 5 = 0")))
    narrow = files.select(
        "api_url", outcomes.outcome(F.col("status_code"), F.col("body")).alias("outcome"), F.length("content").alias("n_chars"), F.col("attempt").alias("_attempt")
    )
    return _attached(candidates, outcomes.final_attempts(narrow, ["api_url"]))


# ---------------------------------------------------------------- aggregations
@query("a1_count_status", "SELECT count(*) AS n FROM skill_index WHERE status = 'approved'")
def _(i):
    return review.count_status(i.skill_index, "approved")


@query(
    "a2_dashboard",
    """SELECT s.status, count(x.id) AS n FROM (VALUES ('pending'), ('approved'), ('rejected'), ('risky'), ('offline')) AS s(status)
  LEFT JOIN skill_index x ON x.status = s.status GROUP BY s.status
UNION ALL SELECT 'total', count(*) FROM skill_index WHERE status IN ('pending', 'approved', 'rejected', 'risky', 'offline')""",
)
def _(i):
    return review.dashboard_rows(i.skill_index)


@query(
    "a3_status_map",
    """SELECT string_agg(status || '=' || n, ',' ORDER BY status) AS counts
FROM (SELECT status, CAST(count(*) AS VARCHAR) AS n FROM skill_index GROUP BY status) AS c""",
)
def _(i):
    entries = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return review.status_map(i.skill_index).select(F.array_join(F.array_sort(entries), ",").alias("counts"))


@query(
    "a4_run_stats",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running,
  count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed FROM scan_tasks""",
)
def _(i):
    return ledger.run_stats(i.scan_tasks)


@query("a5_directory_flags", f"WITH {_LISTED} SELECT repo_full_name, dir, {FLAG_BITS} FROM listed")
def _(i):
    flags = layout.flags_from_listing(landing.listing_items(landed.listing_responses(i)))
    return flags.select("repo_full_name", "dir", *bits(*layout.FLAGS))


@query(
    "a6_directory_counts",
    """WITH below AS (
  SELECT DISTINCT t.repo_full_name, d.dir, t.path, t.type, lower(split_part(substr(t.path, length(d.dir) + 2), '/', 1)) AS child
  FROM (SELECT repo_full_name, regexp_replace(skill_path, '/[^/]*\\z', '') AS dir FROM skill_files) d
  JOIN tree_items t ON t.repo_full_name = d.repo_full_name AND starts_with(t.path, d.dir || '/') AND contains(substr(t.path, length(d.dir) + 2), '/')
)
SELECT repo_full_name, dir, CAST(bool_or(child = 'scripts') AS INT) AS has_scripts, CAST(bool_or(child = 'assets') AS INT) AS has_assets,
  CAST(bool_or(child = 'references') AS INT) AS has_references, CAST(bool_or(child IN ('tests', 'test')) AS INT) AS has_tests,
  count(*) FILTER (WHERE child = 'scripts' AND type = 'blob') AS scripts_count, count(*) FILTER (WHERE child = 'assets' AND type = 'blob') AS assets_count,
  count(*) FILTER (WHERE child = 'references' AND type = 'blob') AS references_count
FROM below WHERE child IN ('scripts', 'assets', 'references', 'tests', 'test') GROUP BY repo_full_name, dir""",
)
def _(i):
    counts = layout.counts_from_tree(i.tree_items)
    return counts.select("repo_full_name", "dir", *bits(*layout.FLAGS), "scripts_count", "assets_count", "references_count")


@query("a9_sorted_flags", f"WITH {q.FLAGGED} SELECT doc_id, array_to_string(flags, ',') AS flags, len(flags) AS n_flags FROM flagged")
def _(i):
    flagged = risk.content_flags(i.skill_files)
    return flagged.select("doc_id", F.array_join("content_flags", ",").alias("flags"), F.size("content_flags").cast("bigint").alias("n_flags"))


# ---------------------------------------------------------------- arrival order
@query(
    "w1_first_seen",
    f"""WITH {FIRSTS}
SELECT hit_key, query_idx, page, pos, repo_full_name, skill_path, count(*) OVER (PARTITION BY hit_key) AS n_seen FROM firsts QUALIFY rn = 1""",
)
def _(i):
    firsts = dedup.first_seen(i.search_hits.filter(dedup.has_required_fields()))
    return firsts.select("hit_key", "query_idx", "page", "pos", "repo_full_name", "skill_path", "n_seen")


_SPELLED = "CASE query_idx % 3 WHEN 0 THEN upper(hit_key) WHEN 1 THEN hit_key || ' ' ELSE replace(hit_key, 'o', 'ö') END"


@query(
    "d9_first_seen_collated",
    f"""WITH {FIRSTS}, spelled AS (SELECT query_idx, page, pos, {_SPELLED} AS hit_key FROM firsts)
SELECT hit_key, query_idx, page, pos, count(*) OVER (PARTITION BY {q.collated('hit_key')}) AS n_seen FROM spelled
QUALIFY row_number() OVER (PARTITION BY {q.collated('hit_key')} ORDER BY query_idx, page, pos) = 1""",
)
def _(i):
    hits = i.search_hits.filter(dedup.has_required_fields())
    firsts = dedup.first_seen(hits, F.expr(_SPELLED.replace("hit_key", "coalesce(nullif(html_url, ''), repo_full_name || '/' || skill_path)")), collation=q.COLLATION)
    return firsts.select("hit_key", "query_idx", "page", "pos", "n_seen")


@query(
    "w1_mark_first_seen",
    f"WITH {FIRSTS} SELECT query_idx, page, pos, hit_key, CASE WHEN rn = 1 THEN 'found' ELSE 'skipped' END AS disposition FROM firsts",
)
def _(i):
    marked = dedup.mark_first_seen(i.search_hits.filter(dedup.has_required_fields()))
    disposition = F.when(F.col("is_first"), "found").otherwise("skipped")
    return marked.select("query_idx", "page", "pos", "hit_key", disposition.alias("disposition"))


READABLE = """stops AS (
  SELECT query_idx, min(page) AS stop FROM search_pages WHERE n_items = 0 OR status_code <> 200 GROUP BY query_idx
), readable AS (
  SELECT p.query_idx, p.page, p.n_items FROM search_pages p LEFT JOIN stops s ON s.query_idx = p.query_idx WHERE stop IS NULL OR page < stop
)"""


@query("w2_readable_pages", f"WITH {READABLE} SELECT query_idx, page, n_items FROM readable")
def _(i):
    return dedup.readable_pages(i.search_pages).select("query_idx", "page", "n_items")


@query(
    "w3_last_wins",
    """WITH b AS (
  SELECT repo_full_name, skill_path, query_idx, html_url, page, pos, query_idx * 10 + page AS first_found_at FROM search_hits
), r AS (
  SELECT *, row_number() OVER (PARTITION BY repo_full_name, skill_path ORDER BY query_idx DESC, page DESC, pos DESC) AS rn,
    first_value(first_found_at) OVER (PARTITION BY repo_full_name, skill_path ORDER BY query_idx, page, pos) AS first_at FROM b
)
SELECT repo_full_name, skill_path, query_idx, html_url, first_at AS first_found_at FROM r WHERE rn = 1""",
)
def _(i):
    batch = i.search_hits.withColumn("first_found_at", F.col("query_idx") * 10 + F.col("page"))
    last = dedup.last_wins(batch, ["repo_full_name", "skill_path"], dedup.ARRIVAL)
    return last.select("repo_full_name", "skill_path", "query_idx", "html_url", "first_found_at")


@query(
    "w4_new_ids",
    """SELECT (SELECT max(id) FROM skill_index) + row_number() OVER (ORDER BY substr(md5(f.repo_full_name || '/' || f.skill_path), 1, 3), f.repo_full_name, f.skill_path) AS id,
  f.repo_full_name, f.skill_path
FROM skill_files f LEFT JOIN skill_index x ON x.repo_full_name = f.repo_full_name AND x.skill_path = f.skill_path WHERE x.id IS NULL""",
)
def _(i):
    fresh = merge.new_keys(i.skill_index, i.skill_files)
    return merge.assign_ids(fresh, i.skill_index.agg(F.max("id")).scalar()).select("id", "repo_full_name", "skill_path")


# ---------------------------------------------------------------- set operations
@query(
    "u1_candidate_stream",
    f"""WITH {KEPT_HITS} SELECT query_idx, CASE query_idx WHEN 1 THEN 'filename:SKILL.md "description:"' WHEN 2 THEN 'filename:SKILL.md "name:"'
    WHEN 3 THEN 'filename:SKILL.md "allowed-tools"' ELSE 'path:skills filename:SKILL.md' END AS query_text,
  page, count(*) AS n_hits, count(DISTINCT skill_path) AS n_paths FROM kept GROUP BY query_idx, page""",
)
def _(i):
    hits = landing.search_hits(landing.search_pages(landed.search_responses(i)))
    counted = hits.groupBy("query_idx", "page").agg(F.count("*").alias("n_hits"), F.countDistinct("skill_path").alias("n_paths"))
    return counted.withColumn("query_text", landing.query_text(F.col("query_idx")))


@query(
    "u2_discovery_union",
    f"""WITH {FIRSTS}, {REFERENCE}, asked AS (
  SELECT DISTINCT owner || '/' || repo AS repo_full_name, skill_path FROM parts WHERE owner IS NOT NULL
), routes AS (
  SELECT 'github_search' AS source_type, repo_full_name, skill_path FROM firsts WHERE rn = 1
  UNION ALL SELECT 'trusted_repo', t.repo_full_name, t.path FROM tree_items t JOIN repos r ON r.repo_full_name = t.repo_full_name
    WHERE suffix(t.path, 'SKILL.md') AND t.type = 'blob' AND t.repo_full_name IN (SELECT repo_full_name FROM known_repos WHERE scan_enabled = 1)
  UNION SELECT 'user_submit', a.repo_full_name, a.skill_path FROM asked a JOIN repos r ON r.repo_full_name = a.repo_full_name
    WHERE suffix(a.skill_path, 'SKILL.md') OR suffix(a.skill_path, 'skill.md')
  UNION SELECT 'user_submit', t.repo_full_name, t.path FROM asked a JOIN repos r ON r.repo_full_name = a.repo_full_name
    JOIN tree_items t ON t.repo_full_name = a.repo_full_name WHERE a.skill_path IS NULL AND suffix(t.path, 'SKILL.md') AND t.type = 'blob'
)
SELECT source_type, repo_full_name, skill_path FROM routes""",
)
def _(i):
    tree, repos = i.tree_items, i.repos
    scope = known_repos.scan_scope(i.known_repos)
    read = tree.select("repo_full_name").distinct()
    asked = stage(submit.targets(i.submissions), "targets")
    [busy], [busy_tree] = busy_keys(asked, ["repo_full_name"], at_least=4), busy_keys(tree, ["repo_full_name"], at_least=4)
    submitted, _ = submit.resolve(asked, repos, tree, read, busy, busy_tree)
    routes = [
        search.candidates(i.search_hits.withColumns({"repo_owner": F.lit(""), "repo_url": F.lit(""), "default_branch": F.lit("main")})),
        scan.scan_candidates(tree, scope, repos, busy_tree),
        submitted,
    ]
    columns = ["source_type", "repo_full_name", "skill_path"]
    return routes[0].select(*columns).unionByName(routes[1].select(*columns)).unionByName(routes[2].select(*columns))


@query(
    "u3_new_and_vanished_keys",
    """SELECT 'new' AS change, f.repo_full_name, f.skill_path FROM skill_files f ANTI JOIN skill_index x ON x.repo_full_name = f.repo_full_name AND x.skill_path = f.skill_path
UNION ALL SELECT 'vanished', x.repo_full_name, x.skill_path FROM skill_index x ANTI JOIN skill_files f ON x.repo_full_name = f.repo_full_name AND x.skill_path = f.skill_path""",
)
def _(i):
    new = merge.new_keys(i.skill_index, i.skill_files).withColumn("change", F.lit("new"))
    gone = merge.vanished_keys(i.skill_index, i.skill_files).withColumn("change", F.lit("vanished"))
    return new.unionByName(gone)
