from pyspark.sql import functions as F

from shelfmark.functions import frontmatter
from shelfmark.functions import text as tx
from shelfmark.functions.frontmatter import front_matter, parse_metadata
from tests.conftest import column


def x():
    return F.col("x")


def parse(spark, *contents):
    df = spark.createDataFrame([(n, c) for n, c in enumerate(contents)], "n int, content string")
    return [r["meta"] for r in parse_metadata(df).orderBy("n").collect()]


def test_full_front_matter(spark):
    [m] = parse(spark, "---\nname: pdf\ndescription: Reads files\nlicense: MIT\ncompatibility: all\n---\n\n# Other\nbody")
    assert (m["name"], m["description"], m["license"], m["compatibility"]) == ("pdf", "Reads files", "MIT", "all")
    assert m["frontmatter_json"] == '{"name": "pdf", "description": "Reads files", "license": "MIT", "compatibility": "all"}'


def test_no_front_matter_falls_back_to_the_body(spark):
    [m] = parse(spark, "# My Skill\n\nFirst line\nsecond   line\n\n## More\n\ntail")
    assert (m["name"], m["description"], m["frontmatter_json"]) == ("My Skill", "First line second line tail", "{}")


def test_gaps_are_filled_one_by_one(spark):
    a, b = parse(spark, "---\nname: kept\n---\n# Title\n\nBody text", "---\ndescription: kept\n---\n# Title\n\nBody text")
    assert (a["name"], a["description"]) == ("kept", "Body text")
    assert (b["name"], b["description"]) == ("Title", "kept")


def test_unusable_files(spark):
    assert parse(spark, "", "   \n\t", None, "no heading at all", "# only a title") == [None] * 5


def test_invalid_yaml_counts_as_no_fields(spark):
    broken, listed, word = parse(spark, "---\nname: [open\n---\n# T\n\nb", "---\n- a\n- b\n---\n# T\n\nb", "---\nword\n---\n# T\n\nb")
    assert [m["name"] for m in (broken, listed, word)] == ["T"] * 3


def test_impossible_date_fails_the_file(spark):
    assert parse(spark, "---\nname: x\ndescription: y\nmade: 2024-99-99\n---\nbody") == [None]


def test_closing_line_needs_a_line_end(spark):
    [m] = parse(spark, "---\nname: x\ndescription: y\n---")
    assert m is None


def test_windows_line_ends(spark):
    [m] = parse(spark, "---\r\nname: x\r\ndescription: y\r\n---\r\nbody")
    assert (m["name"], m["description"]) == ("x", "y")


def test_yaml_types_and_truth(spark):
    yes, zero, spaces, number = parse(
        spark,
        "---\nname: true\ndescription: 1.50\n---\n",
        "---\nname: 0\ndescription: d\n---\n# T\n",
        '---\nname: "  "\ndescription: d\n---\n# T\n',
        "---\nname: 2024-01-02\ndescription: [a, 1]\n---\n",
    )
    assert (yes["name"], yes["description"]) == ("True", "1.5")
    assert zero["name"] == "T"
    assert spaces["name"] == ""
    assert (number["name"], number["description"]) == ("2024-01-02", "['a', 1]")


def test_allowed_tools_spellings(spark):
    got = parse(
        spark,
        "---\nname: a\ndescription: b\nallowed-tools:\n  - x\n  - y\n---\n",
        "---\nname: a\ndescription: b\nallowed_tools: [x, 1]\n---\n",
        "---\nname: a\ndescription: b\nallowed-tools: x, y\n---\n",
        "---\nname: a\ndescription: b\n---\n",
    )
    assert [m["allowed_tools"] for m in got] == [["x", "y"], ["x", "1"], ["x, y"], []]


def test_both_yaml_loaders_agree_on_flat_blocks(spark):
    import yaml

    blocks = ["a: yes\nb: No\nc: null", "k: 1_000\nv: 1.2.3", "t:\n  - x y\n  - 3", "yes: on\nA-b: e1", "x: a - b\ny: (z)", "dup: 1\ndup: 2"]
    got = column(spark, blocks, front_matter(x()).getField("frontmatter_json"))
    import json

    assert [json.loads(g) for g in got] == [json.loads(json.dumps(yaml.safe_load(b))) for b in blocks]


def test_front_matter_json_keeps_what_json_lacks_as_text(spark):
    [got] = column(spark, ["made: 2024-01-02\n3: x\nü: é"], front_matter(x()).getField("frontmatter_json"))
    assert got == '{"made": "2024-01-02", "3": "x", "ü": "é"}'


def test_long_body_is_cut_at_a_word(spark):
    [m] = parse(spark, "# T\n\n" + "word " * 200)
    assert len(m["description"]) <= 303 and m["description"].endswith("word...")


def test_truncate(spark):
    assert column(spark, ["short", "a" * 12, "aaa bbb ccc ddd", "aaaa  bbbbbbbb"], tx.truncate_words(x(), 10)) == [
        "short", "a" * 10 + "...", "aaa bbb...", "aaaa ...",
    ]


def test_heading_marker_alone_takes_the_next_paragraph_along(spark):
    assert column(spark, ["#\n\nswallowed\nkept"], tx.fallback_description(x())) == ["kept"]


def test_unicode_space(spark):
    assert column(spark, ["\u3000 a\u2003b \x1c\x85"], tx.collapse_whitespace(tx.strip(x()))) == ["a b"]
    assert column(spark, ["#\u00a0Title\u2028here\u00a0"], tx.fallback_name(x())) == ["Title\u2028here"]


def test_slug(spark):
    cases = {"Hello World": "hello-world", "a  -- b": "a-b", "-x_y-": "x_y", "Ünï & Co.": "ünï-co", "नमस्ते": "नमसत", "": ""}
    assert column(spark, list(cases), tx.slug(x())) == list(cases.values())


def test_validity(spark):
    rows = [("n", "d"), ("", "d"), (None, "d"), ("n", ""), ("n", None), ("n" * 300, "d"), ("é" * 255, "d")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    got = df.select("k", F.coalesce(tx.is_valid_metadata(F.col("a"), F.col("b")), F.lit(False)).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == [True, False, False, False, False, False, True]


def test_flat_blocks_read_as_the_yaml_reader_does(spark):
    import random

    r = random.Random(6)
    keys = ["name", "description", "license", "allowed-tools", "allowed_tools", "compatibility", "tags", "a_b", "no", "True"]
    values = ["x", "Some words, here", "MIT", "v1.2/3 (old)", "true", "Null", "on", "2024-01-01", "12", "a: b", "'quoted'", "word ", "e1", "~", "[a, b]", "é", "off-by-one", "y"]

    def block():
        lines = []
        for _ in range(r.randrange(1, 5)):
            key = r.choice(keys)
            kind = r.random()
            if kind < 0.6:
                lines.append(f"{key}: {r.choice(values)}")
            else:
                lines.append(f"{key}:")
                lines += [f"  - {r.choice(values)}" for _ in range(r.randrange(0, 3))]
        return "\n".join(lines)

    blocks = [None, "", "name: x", "plain"] + [block() for _ in range(600)]
    df = spark.createDataFrame([(n, b) for n, b in enumerate(blocks)], "n int, b string")
    b = F.col("b")
    got = df.select("n", "b", frontmatter.is_flat(b).alias("flat"), frontmatter.front_matter(b).alias("mine"), frontmatter.read_yaml(b).alias("theirs")).collect()
    for row in got:
        assert row["mine"] == row["theirs"], row["b"]
    assert 60 < sum(row["flat"] for row in got) < 560


def test_long_blocks_do_not_exhaust_the_stack(spark):
    import json

    keys = "\n".join(f"key{n}: some words {n}" .replace(str(n), "abcdefghij"[n % 10] * (n // 10 % 7 + 1) + "x" + "-".join("abcdefghij"[int(d)] for d in str(n)), 1) for n in range(100_000))
    items = "name: x\nallowed-tools:\n" + "\n".join(f"  - Tool{n}" for n in range(20_000))
    rows = column(spark, [keys, items, "- a\n" * 3000], F.struct(frontmatter.is_flat(x()).alias("flat"), frontmatter.front_matter(x()).alias("m")), "string")
    assert [r["flat"] for r in rows] == [True, True, False]
    assert len(json.loads(rows[0]["m"]["frontmatter_json"])) == 100_000
    assert len(rows[1]["m"]["allowed_tools"]) == 20_000 and rows[1]["m"]["allowed_tools"][-1] == "Tool19999"
    assert json.loads(rows[1]["m"]["frontmatter_json"])["allowed-tools"] == rows[1]["m"]["allowed_tools"]
