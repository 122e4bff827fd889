import base64
import json

from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.sources import known_repos, landing, outcomes


def decode(spark, *payloads):
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(payloads)], "n int, b64 string, enc string")
    return [r["content"] for r in landing.decode_base64(df, F.col("b64"), F.col("enc")).orderBy("n").collect()]


def b64(data):
    return base64.b64encode(data).decode()


def test_base64(spark):
    wrapped = base64.encodebytes(("é\n" * 60).encode()).decode()
    got = decode(
        spark,
        (b64(b"hello"), "base64"), (wrapped, "base64"), (b64(b"hello"), "utf-8"), ("", "base64"), (None, "base64"),
        (b64(b"a\xff\xfeb"), "base64"), (b64("a\ufffd".encode() + b"\xff"), "base64"), (b64("\ufffd".encode()), "base64"),
        ("abc", "base64"), ("aGVs*bG8=", "base64"), ("YQ=\n=", "base64"), ("YWJj\r\n", "base64"),
    )
    assert got == ["hello", "é\n" * 60, "", "", "", "ab", "a\ufffd", "\ufffd", "", "hello", "a", "abc"]


def test_search_items(spark, shared):
    item = {"name": "SKILL.md", "path": "a/SKILL.md", "html_url": "h", "url": "u", "repository": {"full_name": "o/r", "html_url": "hr", "owner": {"login": "o"}}}
    pages = [
        {"query_idx": 1, "page": 1, "status_code": 200, "payload": json.dumps({"total_count": 2, "items": [item, {"path": "b"}]})},
        {"query_idx": 1, "page": 2, "status_code": 200, "payload": json.dumps({"total_count": 0})},
        {"query_idx": 2, "page": 1, "status_code": 500, "payload": json.dumps({"items": [item]})},
    ]
    spark.createDataFrame([json.dumps(p) for p in pages], "string").write.text(shared)
    hits = landing.search_hits(landing.search_pages(landing.read_responses(spark, shared, schemas.SEARCH_LANDING)))
    rows = [tuple(r) for r in hits.orderBy("pos").collect()]
    assert rows == [
        (1, 1, 0, "o/r", "hr", "o", "main", "a/SKILL.md", "h", "u"),
        (1, 1, 1, None, None, None, "main", "b", None, None),
    ]


def test_repo_defaults(spark):
    bodies = [
        ("a", 200, json.dumps({"stargazers_count": 5, "license": {"spdx_id": "MIT"}, "default_branch": "dev", "archived": True, "updated_at": "2024-01-02T03:04:05Z"})),
        ("b", 200, json.dumps({"license": None, "default_branch": ""})),
        ("c", 404, "{}"),
    ]
    df = spark.createDataFrame(bodies, "repo_full_name string, status_code int, payload string")
    a, b = landing.repo_stats(df).orderBy("repo_full_name").collect()
    assert (a["stars"], a["repo_license"], a["repo_default_branch"], a["archived"], str(a["repo_updated_at"])) == (5, "MIT", "dev", True, "2024-01-02 03:04:05")
    assert (b["stars"], b["repo_license"], b["repo_default_branch"], b["private"], b["repo_pushed_at"]) == (0, "", "main", False, None)


def test_trees_and_listings(spark):
    tree = spark.createDataFrame([("r", 200, json.dumps({"tree": [{"path": "p", "type": "blob", "size": 3}]}))], "repo_full_name string, status_code int, payload string")
    assert [tuple(r) for r in landing.tree_items(tree).collect()] == [("r", "p", "blob", None, 3)]
    lists = [("r", "d", 200, ' [{"name": "x", "type": "dir"}]'), ("r", "f", 200, '{"name": "SKILL.md", "type": "file"}'), ("r", "e", 404, "[]")]
    df = spark.createDataFrame(lists, "repo_full_name string, dir string, status_code int, payload string")
    assert [tuple(r) for r in landing.listing_items(df).collect()] == [("r", "d", "x", "dir")]


def test_outcomes(spark):
    cases = [
        (200, "", "ok"), (304, "", "not_modified"), (404, "", "not_found"), (403, "API Rate Limit exceeded", "rate_limited"), (403, "no", "auth_error"),
        (401, None, "auth_error"), (429, "", "rate_limited"), (503, "", "server_error"), (410, "", "http_error"),
    ]
    df = spark.createDataFrame(cases, "s int, b string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", outcomes.outcome(F.col("s"), F.col("b"))).collect())


def test_retries(spark):
    log = [
        ("gone", 1, "server_error"), ("gone", 2, "not_found"), ("gone", 3, "ok"),
        ("slow", 1, "rate_limited"), ("slow", 2, "server_error"), ("slow", 3, "http_error"), ("slow", 4, "ok"),
        ("fine", 1, "ok"), ("same", 1, "not_modified"), ("same", 2, "ok"),
    ]
    df = spark.createDataFrame(log, "request string, attempt int, outcome string").repartition(3)
    got = {r["request"]: (r["outcome"], r["n_attempts"]) for r in outcomes.final_outcomes(df, ["request"]).collect()}
    assert got == {"gone": ("not_found", 2), "slow": ("http_error", 3), "fine": ("ok", 1), "same": ("not_modified", 1)}


def test_rate_budget(spark):
    log = spark.createDataFrame([(9, 100, 160), (9, 100, 90), (10, 100, 160), (0, 100, None), (None, 100, 160)], "remaining int, at long, reset long")
    assert [r["wait_seconds"] for r in outcomes.rate_budget(log).collect()] == [61, 0, 0, 0, 0]


def test_scope_and_seeds(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    known = spark.createDataFrame([("a/b", 1), ("c/d", 0)], "repo_full_name string, scan_enabled int")
    names = lambda df: {r["repo_full_name"] for r in df.collect()}
    assert names(known_repos.scan_scope(known)) == {"a/b"}
    assert names(known_repos.scan_scope(known, "x/y")) == {"x/y"}
    assert len(names(known_repos.scan_scope(known.filter("scan_enabled = 0")))) == 2
    assert names(known_repos.with_seeds(known, now)) == {"a/b", "c/d"}
    assert len(names(known_repos.with_seeds(known.filter("false"), now))) == 2
    touched = known_repos.touch_scanned(known, spark.createDataFrame([("c/d",), ("x/y",)], "repo_full_name string"), now)
    assert {r["repo_full_name"]: r["last_scanned_at"] is not None for r in touched.collect()} == {"a/b": False, "c/d": True}


def test_noncharacters_stay_and_broken_bytes_go(spark):
    import base64

    rows = [("a ﷐ b ".encode() + b"\xff \xef\xbf\xbd",), ("﷐0﷐1".encode() + b"\xc3",), ("﷐".encode(),)]
    df = spark.createDataFrame([(base64.b64encode(b).decode(),) for (b,) in rows], "c string")
    got = [r["content"] for r in landing.decode_base64(df, F.col("c"), F.lit("base64")).collect()]
    assert got == ["a ﷐ b  �", "﷐0﷐1", "﷐"]


def test_a_response_without_status_is_an_error(spark):
    df = spark.createDataFrame([(None,), (200,)], "s int")
    assert [r[0] for r in df.select(outcomes.outcome(F.col("s"), F.lit(None))).collect()] == ["http_error", "ok"]


def test_final_attempt_of_each_request(spark):
    rows = [("a", 1, "server_error", "x"), ("a", 2, "ok", "y"), ("a", 3, "not_found", "z"), ("b", 1, "server_error", "x"), ("b", 3, "rate_limited", "y"), ("b", 9, "ok", "z"), ("c", 1, "ok", "p"), ("c", 1, "ok", "q")]
    df = spark.createDataFrame(rows, "u string, _attempt int, outcome string, v string")
    assert {r["u"]: r["v"] for r in outcomes.final_attempts(df, ["u"], 3).collect()} == {"a": "y", "b": "y", "c": "q"}
