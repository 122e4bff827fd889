"""Vocabularies, patterns and formats that results depend on.

Nothing here is logic.  Every value is stated plainly because a different value
would give different results.
"""

# --- discovery vocabulary ---------------------------------------------------
SEARCH_QUERIES = [
    'filename:SKILL.md "description:"',
    'filename:SKILL.md "name:"',
    'filename:SKILL.md "allowed-tools"',
    "path:skills filename:SKILL.md",
]
MANIFEST_SUFFIX = "SKILL.md"
SUBMITTED_SUFFIXES = ["SKILL.md", "skill.md"]
DEFAULT_BRANCH = "main"

# Repositories used when no known repository has been registered.
SEED_REPOSITORIES = [
    # repo_full_name, source_level
    ("anthropics/anthropic-quickstarts", "official"),
    ("modelcontextprotocol/servers", "trusted"),
]

# --- address formats --------------------------------------------------------
SITE = "https://github.com"
API = "https://api.github.com"
RAW = "https://raw.githubusercontent.com"

# --- fetch outcomes ---------------------------------------------------------
MAX_ATTEMPTS = 3
LOW_BUDGET = 10
WAIT_BUFFER_SECONDS = 1

# --- text metadata ----------------------------------------------------------
DESCRIPTION_LIMIT = 300
NAME_LIMIT = 255

# --- layout -----------------------------------------------------------------
LAYOUT_DIRECTORIES = {
    "has_scripts": ["scripts"],
    "has_assets": ["assets"],
    "has_references": ["references"],
    "has_tests": ["tests", "test"],
}

# --- risk -------------------------------------------------------------------
HIGH_RISK_KEYWORDS = [
    "rm -rf",
    "curl | bash",
    "wget",
    "eval(",
    "exec(",
    "PRIVATE_KEY",
    "id_rsa",
    "ssh",
]
MEDIUM_RISK_KEYWORDS = [
    "subprocess",
    "os.system",
    "API_KEY",
    "SECRET",
    "TOKEN",
    ".env",
    "process.env",
]
KEYWORD_FLAGS = {
    "rm -rf": "dangerous_delete",
    "curl | bash": "remote_shell",
    "wget": "network_download",
    "eval(": "dynamic_eval",
    "exec(": "dynamic_exec",
    "subprocess": "command_execute",
    "os.system": "command_execute",
    "process.env": "env_access",
    ".env": "env_file_access",
    "API_KEY": "api_key",
    "SECRET": "secret",
    "TOKEN": "token",
    "PRIVATE_KEY": "private_key",
    "id_rsa": "ssh_key",
    "ssh": "ssh_access",
}
EXTRA_LITERALS = {
    "api key": "needs_api_key",
    "apikey": "needs_api_key",
    "http://": "needs_network",
    "https://": "needs_network",
}
SCRIPTS_FLAG = "contains_scripts"
HIGH_RISK_FLAGS = [
    "dangerous_delete",
    "remote_shell",
    "env_file_access",
    "private_key",
    "ssh_key",
]
RISK_DESCRIPTIONS = {
    "low": "仅包含 SKILL.md，无脚本，无危险命令",
    "medium": "包含脚本或需要 API Key、网络访问",
    "high": "包含危险命令、密钥或敏感信息",
    "unknown": "未知风险",
}
# A pipe of a download into a shell, for the opt-in extended rule set.
PIPED_SHELL_PATTERN = r"curl[^\n|]*\| *(?:sh|bash)"

# --- patterns that decide what a text or a reference means (Java regular expressions) ---
SPACE_PATTERN = r"[\s\x1c-\x1f]"
BLOCK_PATTERN = rf"(?sU)\A---{SPACE_PATTERN}*\n(.*?)\n---{SPACE_PATTERN}*\n"
TITLE_PATTERN = rf"(?mdU)^#{SPACE_PATTERN}+(.+)$"
HEADING_PATTERN = rf"(?mdU)^#+{SPACE_PATTERN}+.+$"
REPOSITORY_URL_PATTERN = r"\Ahttps?://github\.com/([^/]+)/([^/]+)"
FILE_URL_PATTERN = r"(?d)\Ahttps?://github\.com/[^/]+/[^/]+/(?:tree|blob)/([^/\n]+)/(.+)"

# --- index ------------------------------------------------------------------
DASHBOARD_STATUSES = ["pending", "approved", "rejected", "risky", "offline"]
REVIEWED_STATUSES = ["approved", "rejected", "risky"]
RUN_STATUSES = ["pending", "running", "success", "failed"]
RECHECK_DAYS = {"pending": 1, "approved": 7, "risky": 14, "offline": 30}
APPROVE_ABOVE_STARS = 100
