"""Explicit schemas of the index, the ledger and the landed payloads.

Landing data is always read with one of these: an optional field that is absent
from a payload has to arrive as NULL, which schema inference cannot promise.
"""

from pyspark.sql import types as T

STRING, BOOL = T.StringType(), T.BooleanType()
SHORT, INT, LONG = T.ShortType(), T.IntegerType(), T.LongType()
TIME = T.TimestampType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INDEX = struct(
    id=LONG,
    name=STRING,
    description=STRING,
    slug=STRING,
    repo_full_name=STRING,
    repo_owner=STRING,
    repo_name=STRING,
    repo_url=STRING,
    repo_default_branch=STRING,
    skill_path=STRING,
    skill_dir=STRING,
    skill_html_url=STRING,
    skill_raw_url=STRING,
    skill_api_url=STRING,
    skill_sha=STRING,
    skill_size=INT,
    skill_etag=STRING,
    skill_last_modified=STRING,
    frontmatter_json=STRING,
    license=STRING,
    compatibility=STRING,
    allowed_tools=STRING,
    stars=INT,
    forks=INT,
    watchers=INT,
    open_issues=INT,
    repo_license=STRING,
    repo_archived=SHORT,
    repo_disabled=SHORT,
    repo_private=SHORT,
    repo_updated_at=TIME,
    repo_pushed_at=TIME,
    has_scripts=SHORT,
    has_assets=SHORT,
    has_references=SHORT,
    has_tests=SHORT,
    risk_level=STRING,
    risk_flags=STRINGS,
    license_status=STRING,
    source_type=STRING,
    status=STRING,
    first_found_at=TIME,
    last_checked_at=TIME,
    created_at=TIME,
    updated_at=TIME,
)

KEY = ["repo_full_name", "skill_path"]

# What a discovery route delivers: the index row without what the merge assigns.
RECORD_COLUMNS = [c for c in INDEX.names if c not in ("id", "created_at", "updated_at")]

RUN_EVENTS = struct(
    run_id=LONG,
    seq=INT,
    event=STRING,
    task_type=STRING,
    query_text=STRING,
    total_found=LONG,
    total_saved=LONG,
    total_skipped=LONG,
    error_message=STRING,
    at=TIME,
)

COMMITS = struct(version=LONG, path=STRING, batch_id=STRING, buckets=INT, committed_at=TIME, changes=BOOL)

KNOWN_REPOS = struct(
    repo_full_name=STRING,
    repo_url=STRING,
    source_level=STRING,
    scan_enabled=SHORT,
    last_scanned_at=TIME,
    created_at=TIME,
    updated_at=TIME,
)

# --- payloads: the JSON bodies of landed responses ---
SEARCH_ITEM = struct(
    name=STRING,
    path=STRING,
    html_url=STRING,
    url=STRING,
    repository=struct(full_name=STRING, html_url=STRING, default_branch=STRING, owner=struct(login=STRING)),
)
SEARCH_PAYLOAD = struct(total_count=LONG, items=T.ArrayType(SEARCH_ITEM))
CONTENT_PAYLOAD = struct(content=STRING, encoding=STRING, sha=STRING, size=INT, download_url=STRING)
REPO_PAYLOAD = struct(
    stargazers_count=INT,
    forks_count=INT,
    watchers_count=INT,
    open_issues_count=INT,
    license=struct(spdx_id=STRING),
    default_branch=STRING,
    archived=BOOL,
    disabled=BOOL,
    private=BOOL,
    updated_at=STRING,
    pushed_at=STRING,
)
TREE_PAYLOAD = struct(tree=T.ArrayType(struct(path=STRING, type=STRING, sha=STRING, size=LONG)), truncated=BOOL)
LISTING_PAYLOAD = T.ArrayType(struct(name=STRING, type=STRING))

# --- landing rows: which request a response answers, its status, headers and raw body ---
SEARCH_LANDING = struct(query_idx=INT, page=INT, status_code=INT, payload=STRING)
CONTENT_LANDING = struct(
    api_url=STRING, status_code=INT, body=STRING, etag=STRING, last_modified=STRING, payload=STRING
)
REPO_LANDING = struct(repo_full_name=STRING, status_code=INT, body=STRING, payload=STRING)
LISTING_LANDING = struct(repo_full_name=STRING, dir=STRING, status_code=INT, payload=STRING)

# A fetched file as it lands for scheduled ingestion: the candidate it answers and the raw response.
FETCHED = struct(
    seq=LONG,
    repo_full_name=STRING,
    skill_path=STRING,
    skill_html_url=STRING,
    skill_api_url=STRING,
    repo_owner=STRING,
    repo_url=STRING,
    default_branch=STRING,
    source_type=STRING,
    status_code=INT,
    body=STRING,
    etag=STRING,
    last_modified=STRING,
    payload=STRING,
)

HITS = struct(
    seen_at=TIME,
    query_idx=INT,
    page=INT,
    pos=LONG,
    repo_full_name=STRING,
    skill_path=STRING,
    html_url=STRING,
    api_url=STRING,
)
