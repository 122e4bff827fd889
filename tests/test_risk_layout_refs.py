import random

from pyspark.sql import functions as F

from shelfmark.functions import refs, risk
from shelfmark.operators import layout
from tests.conftest import column


def x():
    return F.col("x")


def scan(spark, content, scripts=False, rules=risk.DEFAULT_RULES):
    df = spark.createDataFrame([(content,)], "content string")
    row = risk.scan(df, has_scripts=F.lit(scripts), rules=rules).first()
    return row["risk_level"], row["risk_flags"]


def test_levels(spark):
    assert scan(spark, "plain text") == ("low", [])
    assert scan(spark, "plain text", scripts=True) == ("medium", ["contains_scripts"])
    assert scan(spark, "needs an API key") == ("medium", ["needs_api_key"])
    assert scan(spark, "RM -RF /") == ("high", ["dangerous_delete"])
    assert scan(spark, "my PRIVATE_KEY") == ("high", ["private_key"])
    assert scan(spark, "") == ("unknown", []) and scan(spark, None) == ("unknown", [])


def test_flags_are_sorted_distinct_and_by_substring(spark):
    level, flags = scan(spark, "process.env subprocess os.system https://x http://y tokenizer retrieval(", scripts=True)
    assert level == "high"
    assert flags == ["command_execute", "contains_scripts", "dynamic_eval", "env_access", "env_file_access", "needs_network", "token"]


def test_listed_high_but_only_medium(spark):
    for word in ("wget", "eval(", "exec(", "ssh"):
        assert scan(spark, word)[0] == "medium"


def test_piped_shell_is_literal_unless_extended(spark):
    text = "curl https://x.example/i.sh | bash"
    assert scan(spark, text) == ("medium", ["needs_network"])
    assert scan(spark, text, rules=risk.EXTENDED_RULES) == ("high", ["needs_network", "remote_shell"])
    assert scan(spark, "curl a\n | bash", rules=risk.EXTENDED_RULES)[0] == "low"


def test_keyword_names(spark):
    assert risk.keyword_flag("os.system") == "command_execute" and risk.keyword_flag("Do It(now") == "do_itnow"
    assert column(spark, ["TOKEN", "Do It(now"], risk.keyword_flag_column(x())) == ["token", "do_itnow"]


def test_layout_from_listing(spark):
    rows = [("r", "all", n, "dir") for n in ("scripts", "ASSETS", "References", "test")]
    rows += [("r", "none", "scripts", "file"), ("r", "none", "src", "dir")]
    flags = layout.flags_from_listing(spark.createDataFrame(rows, "repo_full_name string, dir string, name string, type string"))
    files = spark.createDataFrame([("r", p) for p in ("all/SKILL.md", "none/SKILL.md", "gone/SKILL.md", "SKILL.md")], "repo_full_name string, skill_path string")
    got = {r["skill_path"]: [r[f] for f in layout.FLAGS] for r in layout.attach_flags(files, flags).collect()}
    assert got == {"all/SKILL.md": [True] * 4, "none/SKILL.md": [False] * 4, "gone/SKILL.md": [False] * 4, "SKILL.md": [False] * 4}


def test_layout_from_tree_equals_the_prefix_rule(spark):
    rng = random.Random(7)
    parts = ["a", "b", "Scripts", "tests", "test", "assets", "references", ""]
    tree = [("r%d" % rng.randrange(3), "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))), rng.choice(["blob", "tree"])) for _ in range(600)]
    files = sorted({("r%d" % rng.randrange(3), "/".join([*(rng.choice(parts) for _ in range(rng.randrange(0, 4))), "SKILL.md"])) for _ in range(120)})
    names = {"has_scripts": {"scripts"}, "has_assets": {"assets"}, "has_references": {"references"}, "has_tests": {"test", "tests"}}

    def expected(repo, path):
        folder = path.rpartition("/")[0]
        if not folder:
            return [False] * 4
        under = folder.rstrip("/") + "/"
        rest = [p[len(under):] for r, p, _ in tree if r == repo and p.startswith(under)]
        below = {p.split("/")[0].lower() for p in rest if "/" in p}
        return [bool(below & n) for n in names.values()]

    t = spark.createDataFrame(tree, "repo_full_name string, path string, type string")
    f = spark.createDataFrame(files, "repo_full_name string, skill_path string")
    got = {(r["repo_full_name"], r["skill_path"]): [r[x] for x in layout.FLAGS] for r in layout.attach_flags(f, layout.flags_from_tree(t)).collect()}
    assert got == {key: expected(*key) for key in files}


def test_tree_counts_files_not_directories(spark):
    tree = [("r", "d/scripts/a", "blob"), ("r", "d/scripts/x/b", "blob"), ("r", "d/scripts/x", "tree"), ("r", "d/tests", "tree")]
    [row] = layout.counts_from_tree(spark.createDataFrame(tree, "repo_full_name string, path string, type string")).collect()
    assert (row["dir"], row["has_scripts"], row["has_tests"], row["scripts_count"]) == ("d", True, False, 2)


def test_references(spark):
    cases = {
        "owner/repo": ("owner", "repo", None, None),
        "  owner/repo\n": ("owner", "repo", None, None),
        "/repo": ("", "repo", None, None),
        "https://github.com/o/r": ("o", "r", None, None),
        "http://github.com/o/r.git": ("o", "r.git", None, None),
        "https://github.com/o/r/tree/main/skills/x": ("o", "r", "main", "skills/x"),
        "https://github.com/o/r/blob/dev/a/SKILL.md": ("o", "r", "dev", "a/SKILL.md"),
        "https://github.com/o/r/tree/main": ("o", "r", None, None),
        "https://github.com/o/r/issues/1": ("o", "r", None, None),
        "https://www.github.com/o/r": None,
        "github.com/o/r": None,
        "https://gitlab.com/o/r": None,
        "a/b/c": None,
        "nothing": None,
        "": None,
        None: None,
    }
    got = column(spark, list(cases), refs.parse_reference(x()))
    assert [tuple(g) if g else None for g in got] == list(cases.values())
    names = column(spark, list(cases), refs.referenced_repo(x()))
    assert names == ["/".join(c[:2]) if c and c[0] else None for c in cases.values()]
    assert column(spark, list(cases), refs.referenced_path(x())) == [c[3] if c else None for c in cases.values()]


def test_paths_and_addresses(spark):
    assert column(spark, ["a/b/SKILL.md", "SKILL.md", "/SKILL.md"], refs.skill_dir(x())) == ["a/b", "", ""]
    assert column(spark, ["x/SKILL.md", "x/skill.md", "x/Skill.md", "", None], refs.is_manifest_path(x())) == [True, True, False, False, False]
    assert column(spark, ["o/r", "plain"], refs.repo_name(x())) == ["r", ""]
    assert column(spark, ["o/r"], refs.raw_url(x(), F.lit("main"), F.lit("p"))) == ["https://raw.githubusercontent.com/o/r/main/p"]
    assert column(spark, ["o"], refs.full_name(x(), F.lit(""))) == [""]


def test_flags_may_hold_commas(spark):
    rules = (risk.RiskRule("one, two", risk.keyword_flag("one, two")),)
    df = spark.createDataFrame([("say One, two!",), ("no",)], "content string")
    assert [r["content_flags"] for r in risk.content_flags(df, rules=rules).collect()] == [["one,_two"], []]
