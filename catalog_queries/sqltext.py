"""Pieces of oracle SQL that several queries share."""

AS_OF = "2024-03-01 00:00:00"

# Unicode white space as RE2 reads it, and the same characters for trim()
WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CODES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
TRIM = "(" + " || ".join(f"chr({c})" for c in _CODES) + ")"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


COLLATION = "UNICODE_CI_AI_RTRIM"


def collated(key: str) -> str:
    """The collation in plain SQL, for letters of the Latin alphabet."""
    return f"lower(strip_accents(rtrim({key})))"


def block(c: str) -> str:
    return rf"nullif(regexp_extract({c}, '(?s)\A---{WS}*\n(.*?)\n---{WS}*\n', 1), '')"


def rest(c: str) -> str:
    return rf"regexp_replace({c}, '(?s)\A---{WS}*\n(.*?)\n---{WS}*\n', '')"


def title(c: str) -> str:
    return rf"nullif(trim(regexp_extract({rest(c)}, '(?m)^#{WS}+([^\n]+)$', 1), {TRIM}), '')"


def truncated(c: str, n: int = 300) -> str:
    return rf"CASE WHEN length({c}) > {n} THEN regexp_replace(substr({c}, 1, {n}), ' [^ ]*\z', '') || '...' ELSE {c} END"


def body_line(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({rest(c)}, '(?m)^#+{WS}+[^\n]+$', '', 'g'), {TRIM}), '{WS}+', ' ', 'g')"


# metadata per document; y_ columns come from the (flat) front matter
PARSED = rf"""yaml AS (
  SELECT *, {block('content')} AS block FROM skill_files
), fields AS (
  SELECT *, nullif(regexp_extract(block, '(?m)^name: ([^\n]*)$', 1), '') AS y_name,
    nullif(regexp_extract(block, '(?m)^description: ([^\n]*)$', 1), '') AS y_description,
    coalesce(regexp_extract(block, '(?m)^license: ([^\n]*)$', 1), '') AS y_license,
    CASE WHEN contains(coalesce(block, ''), 'allowed-tools:') THEN 'python,bash' ELSE '' END AS y_tools,
    {title('content')} AS f_name, {body_line('content')} AS body_line
  FROM yaml
), named AS (
  SELECT *, coalesce(y_name, f_name) AS name, coalesce(y_description, nullif({truncated('body_line')}, '')) AS full_description
  FROM fields
), parsed AS (
  SELECT *, name IS NOT NULL AND full_description IS NOT NULL AS usable, trim(full_description, {TRIM}) AS description,
    CASE WHEN y_description IS NOT NULL THEN '{{"name": "' || y_name || '", "description": "' || y_description
           || '", "license": "MIT", "allowed-tools": ["python", "bash"]}}'
         WHEN y_name IS NOT NULL THEN '{{"name": "' || y_name || '"}}' ELSE '{{}}' END AS frontmatter_json
  FROM named
)"""

RULES = """rules(literal, flag) AS (VALUES
  ('rm -rf', 'dangerous_delete'), ('curl | bash', 'remote_shell'), ('wget', 'network_download'), ('eval(', 'dynamic_eval'),
  ('exec(', 'dynamic_exec'), ('private_key', 'private_key'), ('id_rsa', 'ssh_key'), ('ssh', 'ssh_access'),
  ('subprocess', 'command_execute'), ('os.system', 'command_execute'), ('api_key', 'api_key'), ('secret', 'secret'),
  ('token', 'token'), ('.env', 'env_file_access'), ('process.env', 'env_access'), ('api key', 'needs_api_key'),
  ('apikey', 'needs_api_key'), ('http://', 'needs_network'), ('https://', 'needs_network'))"""

# flags of the text alone
FLAGGED = f"""{RULES}, hits AS (
  SELECT DISTINCT f.doc_id, r.flag FROM skill_files f JOIN rules r ON contains(lower(f.content), r.literal)
), flagged AS (
  SELECT f.doc_id, coalesce(list_sort(h.flags), []) AS flags
  FROM skill_files f LEFT JOIN (SELECT doc_id, list(flag) AS flags FROM hits GROUP BY doc_id) h USING (doc_id)
)"""


def level(flags: str) -> str:
    high = "['dangerous_delete', 'remote_shell', 'env_file_access', 'private_key', 'ssh_key']"
    return f"CASE WHEN list_has_any({flags}, {high}) THEN 'high' WHEN len({flags}) > 0 THEN 'medium' ELSE 'low' END"


# flags per directory from the recursive trees, by the direct prefix form
LAYOUT = r"""layout AS (
  SELECT f.doc_id, bool_or(c = 'scripts') AS has_scripts, bool_or(c = 'assets') AS has_assets,
    bool_or(c = 'references') AS has_references, bool_or(c IN ('tests', 'test')) AS has_tests
  FROM (SELECT s.doc_id, CASE WHEN starts_with(t.path, s.dir || '/') AND contains(substr(t.path, length(s.dir) + 2), '/')
          THEN lower(split_part(substr(t.path, length(s.dir) + 2), '/', 1)) ELSE '' END AS c
        FROM (SELECT doc_id, repo_full_name, regexp_replace(skill_path, '/[^/]*\z', '') AS dir FROM skill_files) s
        JOIN tree_items t ON t.repo_full_name = s.repo_full_name) f
  GROUP BY f.doc_id
)"""

# flags per directory from landed listings; a nineteenth of those are no listing
LISTED = """listed AS (
  SELECT repo_full_name, dir, bool_or(type = 'dir' AND lower(name) = 'scripts') AS has_scripts, bool_or(type = 'dir' AND lower(name) = 'assets') AS has_assets,
    bool_or(type = 'dir' AND lower(name) = 'references') AS has_references, bool_or(type = 'dir' AND lower(name) IN ('tests', 'test')) AS has_tests
  FROM listing_items WHERE doc_id % 19 <> 0 GROUP BY repo_full_name, dir
)"""
LISTED_LAYOUT = LISTED + r""", layout AS (
  SELECT f.doc_id, coalesce(l.has_scripts, false) AS has_scripts, coalesce(l.has_assets, false) AS has_assets,
    coalesce(l.has_references, false) AS has_references, coalesce(l.has_tests, false) AS has_tests
  FROM skill_files f LEFT JOIN listed l ON l.repo_full_name = f.repo_full_name AND l.dir = regexp_replace(f.skill_path, '/[^/]*\z', '')
)"""

OUTCOME = """CASE WHEN status_code = 304 THEN 'not_modified' WHEN status_code = 404 THEN 'not_found'
  WHEN status_code IN (401, 403) AND contains(lower(body), 'rate limit') THEN 'rate_limited'
  WHEN status_code IN (401, 403) THEN 'auth_error' WHEN status_code = 429 THEN 'rate_limited'
  WHEN status_code >= 500 THEN 'server_error' WHEN status_code >= 400 THEN 'http_error' ELSE 'ok' END"""
