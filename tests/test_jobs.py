import base64
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import counters, ledger
from shelfmark.plans import jobs, records, refresh, scan, search, submit
from shelfmark.sources import index_store, landing
from shelfmark.streaming import first_seen, ingest

NOW = datetime(2024, 3, 1)
API = "https://api.github.com/repos/{}/contents/{}"


def payload(text):
    return json.dumps({"content": base64.b64encode(text.encode()).decode(), "encoding": "base64", "sha": "s", "size": len(text)})


GOOD = "---\nname: {}\ndescription: d\n---\nrm -rf"
FILES = [  # repository, path, status, text
    ("o/a", "x/SKILL.md", 200, GOOD.format("x")),
    ("o/a", "y/SKILL.md", 200, "no metadata"),
    ("o/a", "SKILL.md", 304, ""),
    ("o/b", "z/SKILL.md", 404, ""),
    ("o/b", "w/SKILL.md", 200, "# W\n\nwords"),
    ("o/c", "v/SKILL.md", 200, GOOD.format("v")),
]


@pytest.fixture(scope="module")
def world(spark):
    rows = [(API.format(r, p), s, "", "e", "m", payload(t)) for r, p, s, t in FILES]
    answers = spark.createDataFrame(rows, schemas.CONTENT_LANDING)
    stats = [(r, 200, json.dumps({"stargazers_count": n, "default_branch": b})) for r, n, b in (("o/a", 3, "dev"), ("o/b", 4, ""))]
    repos = landing.repo_stats(spark.createDataFrame(stats, "repo_full_name string, status_code int, payload string"))
    tree = spark.createDataFrame([(r, p, "blob") for r, p, _, _ in FILES] + [("o/a", "x/SKILL.md/SKILL.md", "tree"), ("o/a", "x/readme", "blob")], "repo_full_name string, path string, type string")
    flags = spark.createDataFrame([("o/b", "w", True, False, False, True)], "repo_full_name string, dir string, has_scripts boolean, has_assets boolean, has_references boolean, has_tests boolean")
    return {"contents": landing.file_contents(answers), "repos": repos, "tree": tree, "layout": flags, "as_of": F.lit(NOW)}


def totals(df):
    return tuple(counters.acquisition_counters(df).first())


def search_pages(spark):
    def item(repo, path, html="page", url=True):
        return {"path": path, "html_url": f"{html}/{repo}/{path}" if html else None, "url": API.format(repo, path) if url else None,
                "repository": {"full_name": repo, "html_url": "u", "default_branch": "trunk", "owner": {"login": "o"}}}

    pages = [
        (1, 1, [item("o/a", "x/SKILL.md"), item("o/a", "y/SKILL.md"), item("o/a", "x/SKILL.md"), item("o/a", "q/SKILL.md", url=False)]),
        (1, 2, []),
        (1, 3, [item("o/b", "w/SKILL.md")]),
        (2, 1, [item("o/a", "x/SKILL.md"), item("o/a", "SKILL.md", html=None), item("o/c", "v/SKILL.md"), item("o/z", "none/SKILL.md")]),
    ]
    rows = [(q, p, 200, json.dumps({"items": items})) for q, p, items in pages]
    return landing.search_pages(spark.createDataFrame(rows, schemas.SEARCH_LANDING))


def test_search(spark, world):
    got = search.search_dispositions(search_pages(spark), world["contents"], world["repos"], world["layout"], world["as_of"])
    # x and v are saved, y has no metadata, the last one was never fetched, one hit lacks its address
    assert totals(got) == (5, 2, 3, 3)
    saved = {r["name"]: r for r in records.saved_records(got).collect()}
    assert set(saved) == {"x", "v"}
    x, v = saved["x"], saved["v"]
    assert (x["stars"], x["repo_default_branch"], x["skill_raw_url"]) == (3, "dev", "https://raw.githubusercontent.com/o/a/dev/x/SKILL.md")
    assert (v["stars"], v["repo_default_branch"], v["repo_license"], v["repo_updated_at"]) == (0, "trunk", "", None)
    assert (x["risk_level"], x["risk_flags"], x["status"], x["source_type"], x["license_status"]) == ("high", ["dangerous_delete"], "pending", "github_search", "unknown")


def test_scan(spark, world):
    scope = spark.createDataFrame([("o/b",), ("o/c",), ("o/none",)], "repo_full_name string")
    got = scan.scan_dispositions(world["tree"], scope, world["contents"], world["repos"], world["layout"], world["as_of"])
    assert totals(got) == (2, 1, 0, 1)  # o/c has no statistics and is passed over
    [w] = records.saved_records(got).collect()
    assert (w["name"], w["skill_html_url"]) == ("W", "https://github.com/o/b/blob/main/w/SKILL.md")
    assert (w["risk_level"], w["risk_flags"], w["has_scripts"], w["has_tests"], w["has_assets"]) == ("medium", ["contains_scripts"], 1, 1, 0)


def test_submissions(spark, world):
    urls = ["o/a"] * 3 + ["https://github.com/o/b/blob/other/w/SKILL.md"] * 2 + ["o/none", "bad", "https://github.com/o/a/tree/main/docs", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = submit.submit_dispositions(df, world["tree"], world["contents"], world["repos"], world["layout"], world["as_of"])
    # three scans of o/a (saved, failed, unchanged each), two single files, five failures
    assert totals(got) == (11, 5, 3, 8)
    given = df.limit(1).withColumn("path", F.lit("x/SKILL.md"))
    assert totals(submit.submit_dispositions(given, world["tree"], world["contents"], world["repos"], world["layout"], world["as_of"])) == (1, 1, 0, 0)
    no_tree = spark.createDataFrame([("o/b",)], "repo_full_name string")
    got = submit.submit_dispositions(df.limit(3), world["tree"], world["contents"], world["repos"], world["layout"], world["as_of"], trees=no_tree)
    assert totals(got) == (0, 0, 0, 3)


def test_jobs_write_index_and_ledger(spark, world, shared):
    store = index_store.IndexStore(spark, f"{shared}/index", buckets=2)
    log = index_store.EventLog(spark, f"{shared}/runs")

    def route():
        return search.search_dispositions(search_pages(spark), world["contents"], world["repos"], world["layout"], world["as_of"])

    got = jobs.Run(store, log, 1, NOW).acquire("code_search", "q", route, ["query_idx", "page", "pos"])
    assert got == {"total_found": 5, "total_saved": 2, "total_skipped": 3, "total_failed": 3}
    assert sorted((r["id"], r["name"]) for r in store.read().collect()) in ([(1, "x"), (2, "v")], [(1, "v"), (2, "x")])

    with pytest.raises(RuntimeError):
        jobs.Run(store, log, 2, NOW).acquire("code_search", "q", lambda: (_ for _ in ()).throw(RuntimeError("boom")))
    nothing = jobs.Run(store, log, 3, NOW).refresh(world["contents"], world["repos"], world["layout"])
    assert set(nothing.values()) == {0}
    states = {r["run_id"]: (r["status"], r["total_found"], r["total_failed"], r["error_message"]) for r in ledger.current_state(log.read()).collect()}
    assert states == {1: ("success", 5, 0, None), 2: ("failed", 0, 0, "boom"), 3: ("success", 0, 0, None)}


def due_index(spark):
    rows = [(n, r, p, API.format(r, p), "e" if p == "w/SKILL.md" else "old", "approved", 77, p.rpartition("/")[0]) for n, (r, p, _, _) in enumerate(FILES)]
    rows += [(90, "o/a", "u", "unknown", None, "approved", 1, ""), (91, "o/a", "t", API.format("o/a", "x/SKILL.md"), "old", "pending", 1, "")]
    return index_store.conform(spark.createDataFrame(rows, "id long, repo_full_name string, skill_path string, skill_api_url string, skill_etag string, status string, stars int, skill_dir string").withColumn("slug", F.lit("s")))


def test_refresh(spark, world):
    old = due_index(spark)
    changes = refresh.plan_refresh(old, world["contents"], world["repos"], world["layout"])
    effects = {r["id"]: r["effect"] for r in changes.collect()}
    assert effects == {0: "updated", 1: "unusable", 2: "not_modified", 3: "offline", 4: "not_modified", 5: "updated", 90: "error"}
    assert tuple(counters.refresh_counters(changes).first()) == (6, 2, 2, 1, 2)
    after = {r["id"]: r for r in refresh.apply_refresh(old, changes, world["as_of"]).collect()}
    assert (after[0]["name"], after[0]["stars"], after[0]["status"], after[0]["slug"], after[0]["last_checked_at"]) == ("x", 3, "approved", None, NOW)
    assert after[5]["stars"] == 77 and after[5]["skill_etag"] == "e"
    assert (after[3]["status"], after[3]["last_checked_at"], after[3]["updated_at"]) == ("offline", None, NOW)
    assert (after[2]["last_checked_at"], after[1]["updated_at"], after[91]["updated_at"]) == (NOW, None, None)


def fetched(spark, files, start=0):
    rows = [(start + n, r, p, "h", API.format(r, p), "o", "u", "main", "trusted_repo", s, "", "e", "m", payload(t)) for n, (r, p, s, t) in enumerate(files)]
    return spark.createDataFrame(rows, schemas.FETCHED)


def test_a_run_folds_its_micro_batches_once(spark, world, shared):
    store = index_store.IndexStore(spark, f"{shared}/index")
    pending = ingest.Pending(store, "files")

    def run(max_files=None):
        return ingest.ingest(spark, f"{shared}/landing", f"{shared}/checkpoint", pending, lambda: world["repos"], lambda: world["layout"], NOW, max_files)

    fetched(spark, FILES).repartition(3).write.json(f"{shared}/landing")
    assert run(max_files=1) == 1, "several micro-batches make one version"
    assert run() == 1, "nothing new, no new version"
    again = fetched(spark, [("o/a", "x/SKILL.md", 200, GOOD.format("older")), ("o/a", "x/SKILL.md", 200, GOOD.format("newer"))], 10)
    again.coalesce(1).write.mode("append").json(f"{shared}/landing")
    assert run() == 2
    assert {r["name"] for r in store.read().collect()} == {"newer", "W", "v"}

    other = index_store.IndexStore(spark, f"{shared}/batch")
    kept = ingest.Pending(other, "files")
    for n, part in enumerate((fetched(spark, FILES), again)):
        records = ingest.fetched_records(part, world["repos"], world["layout"], NOW)
        kept.add(records, n)
        kept.add(records, n)  # a batch that is replayed
        assert kept.fold(NOW) == n + 1
    assert kept.fold(NOW) == 2
    rows = lambda s: sorted(map(repr, s.read().collect()))
    assert rows(other) == rows(store)


def test_first_seen_across_runs(spark, shared):
    seen = first_seen.FirstSeen(spark, f"{shared}/seen")

    def land(*hits):
        rows = [(datetime(2024, 6, 1) + timedelta(days=day), 1, 1, 0, "o/r", path, f"h{path}", api) for day, path, api in hits]
        spark.createDataFrame(rows, schemas.HITS).coalesce(1).write.mode("append").json(f"{shared}/landing")

    def run():
        seen.run(first_seen.hit_stream(spark, f"{shared}/landing"), f"{shared}/checkpoint").awaitTermination()
        return sorted(r["hit_key"] for r in seen.firsts().collect())

    assert seen.firsts().count() == seen.rejected().count() == 0
    land((1, "a", "u"), (1, "b", "u"), (2, "a", "u"), (2, "z", None))
    assert run() == ["ha", "hb"]
    # a repeat, a new key, and a new key that was seen long before
    land((3, "b", "u"), (3, "c", "u"), (-150, "late", "u"))
    assert run() == ["ha", "hb", "hc", "hlate"]
    assert {(r["batch"], r["n"]) for r in seen.rejected().collect()} == {(0, 1), (1, 0)}
    batch = seen.firsts().filter("batch = 1").select(*schemas.HITS.names)
    seen.add(batch, 1)  # replayed
    assert run() == ["ha", "hb", "hc", "hlate"]


def test_files_found_twice_are_one_row_however_often_the_job_runs(spark, world, shared):
    store = index_store.IndexStore(spark, f"{shared}/index")
    log = index_store.EventLog(spark, f"{shared}/runs")
    asked = spark.createDataFrame([("o/a",), ("https://github.com/o/a/blob/main/x/SKILL.md",), ("o/a",)], "url string")
    twice = {k: world[k].unionByName(world[k]) for k in ("tree", "contents", "repos")}

    def route():
        return submit.submit_dispositions(asked, twice["tree"], twice["contents"], twice["repos"], world["layout"], world["as_of"])

    for n in range(2):
        got = jobs.Run(store, log, n, NOW).acquire("user_submit", "q", route)
        rows = store.read().select("id", *schemas.KEY).collect()
        assert len(rows) == len({(r[1], r[2]) for r in rows}) == len({r[0] for r in rows})
        # three requests for x, two for each other file of o/a
        assert got["total_found"] == 3 + 2 * 2
    scanned = scan.scan_dispositions(twice["tree"], spark.createDataFrame([("o/a",), ("o/a",)], "repo_full_name string"), twice["contents"], twice["repos"], world["layout"], world["as_of"])
    assert scanned.groupBy(*schemas.KEY).count().filter("count > 1").count() == 0


def test_a_scan_stamps_the_repositories_in_scope(spark, world, shared):
    known = index_store.IndexStore(spark, f"{shared}/known", schema=schemas.KNOWN_REPOS)
    rows = spark.createDataFrame([("o/a", 1), ("o/z", 1)], "repo_full_name string, scan_enabled int")
    known.publish(rows, NOW)
    run = jobs.Run(index_store.IndexStore(spark, f"{shared}/index"), index_store.EventLog(spark, f"{shared}/runs"), 1, NOW)
    scope = spark.createDataFrame([("o/a",)], "repo_full_name string")
    run.scan(known, "one", scope, lambda: scan.scan_dispositions(world["tree"], scope, world["contents"], world["repos"], world["layout"], world["as_of"]))
    assert {r["repo_full_name"]: r["last_scanned_at"] for r in known.read().collect()} == {"o/a": NOW, "o/z": None}


def test_the_whole_error_is_kept(spark, shared):
    store, log = index_store.IndexStore(spark, f"{shared}/index"), index_store.EventLog(spark, f"{shared}/runs")
    message = "long " * 2000
    with pytest.raises(RuntimeError):
        jobs.Run(store, log, 1, NOW).acquire("code_search", "q", lambda: (_ for _ in ()).throw(RuntimeError(message)))
    assert ledger.current_state(log.read()).first()["error_message"] == message


def test_staged_folders_go_with_the_run(spark, shared):
    import os

    from shelfmark import session

    with session.staging(spark):
        rows = session.stage(spark.range(3), "mine")
        path = rows.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_text_is_parsed_once_and_never_shuffled(spark, world):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = scan.with_addresses(world["tree"].select("repo_full_name", F.col("path").alias("skill_path"), F.lit("main").alias("default_branch")), "trusted_repo")
        built = records.build_records(files, world["contents"], world["repos"], world["layout"], world["as_of"])
        plan = built._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.toString().count("ArrowEvalPython [") == 1
    shuffled = [c for e in exchanges(plan) for c in e]
    assert shuffled and not {"content", "_lower", "payload"} & set(shuffled)


def exchanges(plan):
    """Names of the columns that each exchange below ``plan`` moves."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    found = []
    if plan.nodeName() == "Exchange":
        output = plan.output()
        found.append([output.apply(k).name() for k in range(output.size())])
    children = plan.children()
    for k in range(children.size()):
        found += exchanges(children.apply(k))
    return found


def test_a_refresh_writes_only_the_rows_it_changes(spark, world, shared):
    from pathlib import Path

    store, log = index_store.IndexStore(spark, f"{shared}/index"), index_store.EventLog(spark, f"{shared}/runs")
    old = due_index(spark)
    store.publish(old, NOW)
    files = set(Path(f"{shared}/index").rglob("*.parquet"))
    whole = refresh.apply_refresh(old, refresh.plan_refresh(old, world["contents"], world["repos"], world["layout"]), world["as_of"])
    run = jobs.Run(store, log, 1, NOW)
    totals = run.refresh(world["contents"], world["repos"], world["layout"])
    written = sum(spark.read.parquet(str(f)).count() for f in set(Path(f"{shared}/index").rglob("*.parquet")) - files)
    assert 0 < written <= totals["checked"] < old.count() + totals["checked"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.read()) == rows(whole.select(*store.read().columns))
    assert run.review(spark.createDataFrame([(1, "rejected"), (77, "approved")], "id long, new_status string")) == 3
    assert store.read().filter("id = 1").first().status == "rejected"


def test_stored_keys_are_not_shuffled(spark, shared):
    seen = first_seen.FirstSeen(spark, shared)
    hit = {f.name: None for f in schemas.HITS.fields}
    hits = lambda *paths: spark.createDataFrame([{**hit, "repo_full_name": "a/a", "skill_path": p, "api_url": p} for p in paths], schemas.HITS)
    seen.add(hits("p1", "p2", "p1"), 0)
    fresh = seen.fresh(hits("p2", "p3"), 1)
    assert [r.skill_path for r in fresh.collect()] == ["p3"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and "hashpartitioning(hit_key" not in final, final


def test_folded_batches_are_removed(spark, world, shared):
    from pathlib import Path

    store = index_store.IndexStore(spark, f"{shared}/index")
    pending = ingest.Pending(store, "feed")
    rows = due_index(spark).select(*[c for c in schemas.INDEX.names if c in schemas.RECORD_COLUMNS])
    found = rows.withColumn("seq", F.lit(1).cast("long"))
    pending.add(found, 0)
    pending.add(found.limit(1), 1)
    version = pending.fold(NOW)
    assert version == 1 and not list(Path(pending.path).rglob("*.parquet"))
    pending.add(found.limit(2), 1)  # replayed after the fold: it counts no more
    assert pending.fold(NOW) == 1 and store.read().count() == found.count()


def test_truncated_trees_are_told(spark, world):
    def answer(repo, status, **body):
        return (repo, status, json.dumps(body))

    blob = [{"path": "z/SKILL.md", "type": "blob"}]
    answers = [answer("o/a", 200, tree=[], truncated=False), answer("o/a", 200, tree=blob, truncated=True), answer("o/b", 200, tree=blob), answer("o/e", 404, truncated=True), ("o/f", 200, "not json")]
    trees = landing.trees_read(spark.createDataFrame(answers, "repo_full_name string, status_code int, payload string"))
    assert {r.repo_full_name: r.truncated for r in trees.collect()} == {"o/a": True, "o/b": False, "o/f": False}

    scope = spark.createDataFrame([("o/a",), ("o/b",), ("o/c",), ("o/a",)], "repo_full_name string")
    got = {r.repo_full_name: (r.seen, r.n_files) for r in scan.scan_coverage(world["tree"], scope, world["repos"], trees).collect()}
    assert got == {"o/a": ("in part", 3), "o/b": ("whole", 2), "o/c": ("no statistics", 1)}
    assert {r.seen for r in scan.scan_coverage(world["tree"], scope, world["repos"], trees.limit(0)).collect()} == {"no tree", "no statistics"}

    args = [world[k] for k in ("contents", "repos", "layout", "as_of")]
    files = scan.scan_dispositions(world["tree"], scope, *args, trees=trees)
    assert {(r.repo_full_name, r.seen_in_part) for r in files.collect()} == {("o/a", True), ("o/b", False)}
    assert totals(files) == totals(scan.scan_dispositions(world["tree"], scope, *args))

    asked = spark.createDataFrame([("o/a",), ("https://github.com/o/b/blob/other/w/SKILL.md",)], "url string")
    files = submit.submit_dispositions(asked, world["tree"], *args, trees=trees)
    assert {(r.repo_full_name, r.seen_in_part) for r in files.collect()} == {("o/a", True), ("o/b", False)}


def test_a_run_under_a_collation_knows_respelled_keys(spark, world, shared):
    store = index_store.IndexStore(spark, f"{shared}/collated", buckets=2)
    run = jobs.Run(store, index_store.EventLog(spark, f"{shared}/collated-runs"), 1, NOW, collation="UNICODE_CI_AI_RTRIM")
    args = [world[k] for k in ("contents", "repos", "layout", "as_of")]
    scope = spark.createDataFrame([("o/a",), ("o/b",)], "repo_full_name string")
    run.acquire("repo_tree", "first", lambda: scan.scan_dispositions(world["tree"], scope, *args))
    before = {(r.id, r.repo_full_name, r.skill_path) for r in store.read().collect()}
    spelled = lambda: scan.scan_dispositions(world["tree"], scope, *args).withColumns({"repo_full_name": F.upper("repo_full_name"), "skill_path": F.concat("skill_path", F.lit(" "))})
    run.acquire("repo_tree", "second", spelled)
    assert before and {(r.id, r.repo_full_name, r.skill_path) for r in store.read().collect()} == before
