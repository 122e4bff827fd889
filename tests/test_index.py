from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import ledger, merge, review
from shelfmark.sources import index_store

T0, T1 = datetime(2024, 1, 1), datetime(2024, 3, 1)
KEY = schemas.KEY


def index(spark, rows=None):
    rows = rows or [(1, "a/a", "p1", 5, "approved", T0), (2, "a/a", "p2", 6, "pending", T0), (7, "b/b", "p1", 7, "risky", T0)]
    df = spark.createDataFrame(rows, "id long, repo_full_name string, skill_path string, stars int, status string, created_at timestamp")
    return index_store.conform(df.withColumns({"first_found_at": F.col("created_at"), "updated_at": F.col("created_at")}))


def batch(spark):
    rows = [("a/a", "p1", 50, "pending"), ("b/b", "p1", None, "pending"), ("c/c", "p9", 9, "pending"), ("c/c", "p8", 8, "pending")]
    df = spark.createDataFrame(rows, "repo_full_name string, skill_path string, stars int, status string")
    return df.withColumn("first_found_at", F.lit(T1))


def state(df, *columns):
    return {(r["repo_full_name"], r["skill_path"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_upsert(spark):
    after = merge.upsert(index(spark), batch(spark), F.lit(T1))
    got = state(after, "stars", "status", "first_found_at", "created_at", "updated_at")
    assert got == {
        ("a/a", "p1"): (50, "pending", T0, T0, T1),
        ("a/a", "p2"): (6, "pending", T0, T0, T0),
        ("b/b", "p1"): (None, "pending", T0, T0, T1),
        ("c/c", "p9"): (9, "pending", T1, T1, T1),
        ("c/c", "p8"): (8, "pending", T1, T1, T1),
    }
    ids = state(after, "id")
    assert ids[("a/a", "p1")] == (1,) and ids[("b/b", "p1")] == (7,)
    assert sorted(ids[k][0] for k in ids if k[0] == "c/c") == [8, 9]


def test_upsert_is_idempotent_and_ids_do_not_depend_on_partitions(spark):
    once = merge.upsert(index(spark), batch(spark), F.lit(T1))
    twice = merge.upsert(once, batch(spark).repartition(7), F.lit(T1))
    again = merge.upsert(index(spark).repartition(5), batch(spark).repartition(3), F.lit(T1))
    assert state(once, *schemas.INDEX.names) == state(twice, *schemas.INDEX.names) == state(again, *schemas.INDEX.names)


def test_update_columns_and_review(spark):
    only = state(merge.upsert(index(spark), batch(spark), F.lit(T1), update_columns=["stars"]), "stars", "status")
    assert only[("a/a", "p1")] == (50, "approved")
    kept = state(merge.upsert(index(spark), batch(spark), F.lit(T1), preserve_review=True), "stars", "status")
    assert kept[("a/a", "p1")] == (50, "approved") and kept[("b/b", "p1")] == (None, "risky")


def test_upsert_into_nothing(spark):
    empty = spark.createDataFrame([], schemas.INDEX)
    assert sorted(r["id"] for r in merge.upsert(empty, batch(spark), F.lit(T1)).collect()) == [1, 2, 3, 4]


def test_many_new_ids_are_dense(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("o/r"), F.col("id") % 7).alias("repo_full_name"), F.col("id").cast("string").alias("skill_path"))
    got = merge.assign_ids(rows, F.lit(100)).agg(F.min("id"), F.max("id"), F.countDistinct("id")).first()
    assert tuple(got) == (101, 20_100, 20_000)


def test_status_changes(spark):
    changes = spark.createDataFrame([(1, "rejected"), (99, "rejected")], "id long, new_status string")
    after = {r["id"]: (r["status"], r["updated_at"]) for r in merge.set_status(index(spark), changes, F.lit(T1)).collect()}
    assert after == {1: ("rejected", T1), 2: ("pending", T0), 7: ("risky", T0)}
    assert {r["id"]: r["applied"] for r in merge.status_results(index(spark), changes).collect()} == {1: True, 99: False}
    touched = {r["id"]: (r["last_checked_at"], r["status"]) for r in merge.touch_checked(index(spark), changes, F.lit(T1)).collect()}
    assert touched == {1: (T1, "approved"), 2: (None, "pending"), 7: (None, "risky")}


def test_bulk_review(spark):
    rows = [(101, "low", "pending"), (100, "low", "pending"), (500, "low", "approved"), (500, "high", "pending"), (1, "high", "offline")]
    df = spark.createDataFrame(rows, "stars int, risk_level string, status string").withColumn("updated_at", F.lit(T0))
    got = merge.bulk_review(df, F.lit(T1)).collect()
    assert [(r["status"], r["updated_at"] == T1) for r in got] == [
        ("approved", True), ("pending", False), ("approved", False), ("risky", True), ("offline", False),
    ]


@pytest.mark.parametrize("buckets", [None, 4])
def test_store(spark, shared, buckets):
    store = index_store.IndexStore(spark, shared, buckets=buckets)
    assert store.version() == 0 and store.read().count() == 0
    assert store.publish(index(spark), T0, "one") == 1
    assert store.publish(merge.upsert(store.read(), batch(spark), F.lit(T1)), T1, "two") == 2
    assert store.publish(store.read().limit(0), T1, "two") == 2, "a batch that was committed before changes nothing"
    assert store.read().schema == schemas.INDEX and store.read().count() == 5 and store.read(1).count() == 3
    other = index_store.IndexStore(spark.newSession(), shared)
    assert other.read().count() == 5


def test_bucketed_index_is_not_shuffled_by_a_merge(spark, shared):
    store = index_store.IndexStore(spark, shared, buckets=4)
    store.publish(index(spark), T0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = store.read().join(batch(spark).select(*KEY, F.lit(1).alias("hit")), KEY, "left")
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_a_second_writer_is_refused_and_old_versions_go(spark, shared):
    import os

    store = index_store.IndexStore(spark, f"{shared}/index")
    store.publish(index(spark), T0)
    late = index_store.IndexStore(spark, f"{shared}/index")
    late.version = lambda: 0  # it looked before the first one had committed
    with pytest.raises(index_store.ConcurrentWriter):
        late.publish(index(spark).limit(0), T0)
    assert store.version() == 1 and store.read().count() == index(spark).count()
    for _ in range(2):
        store.publish(store.read(), T1)
    assert store.remove_old(keep=1) == [2, 1]
    assert store.read().count() == index(spark).count()
    assert len([d for d in os.listdir(f"{shared}/index/versions") if not d.startswith(".") and "v00000003" in d]) == 1


def test_repeated_ids_and_keys_do_not_double_rows(spark):
    base = index(spark)
    n = base.count()
    some = base.select("id").limit(1).first()["id"]
    changes = spark.createDataFrame([(some, "approved", 1), (some, "rejected", 2), (some, "approved", 0)], "id long, new_status string, at int")
    after = merge.set_status(base, changes, F.lit(T1), ["at"])
    assert after.count() == n and after.filter(F.col("id") == some).first()["status"] == "rejected"
    for touched in (merge.mark_offline(base, changes, F.lit(T1)), merge.touch_checked(base, changes, F.lit(T1))):
        assert touched.count() == n
    one = base.filter(F.col("id") == some).select("repo_full_name", "skill_path", "skill_sha")
    twice = one.unionByName(one.withColumn("skill_sha", F.lit("zz")))
    upserted = merge.upsert(base, twice, F.lit(T1))
    assert upserted.count() == n and upserted.filter(F.col("id") == some).first()["skill_sha"] == "zz"


def test_change_classes_fall_back_to_the_hash(spark):
    columns = "repo_full_name string, skill_path string, skill_etag string, skill_sha string"
    old = spark.createDataFrame([("r", "a", "e", "s"), ("r", "b", None, "s"), ("r", "c", None, "s"), ("r", "d", "e", "s"), ("r", "g", "e", "s")], columns)
    now = spark.createDataFrame([("r", "a", "e", "t"), ("r", "b", "x", "s"), ("r", "c", None, "t"), ("r", "d", "f", "s"), ("r", "n", "e", "s")], columns)
    got = {r["skill_path"]: r["change"] for r in merge.change_classes(old, now).collect()}
    assert got == {"a": "unchanged", "b": "unchanged", "c": "modified", "d": "modified", "g": "gone", "n": "new"}


def test_a_failed_publish_leaves_the_last_version(spark, shared):
    store = index_store.IndexStore(spark, shared)
    store.publish(index(spark), T0)
    broken = index(spark).withColumn("stars", F.raise_error(F.lit("boom")).cast("int"))
    with pytest.raises(Exception, match="boom"):
        store.publish(broken, T1)
    assert store.version() == 1 and store.read().count() == 3


def test_exports_keep_any_text(spark, shared):
    odd = ['say "hi", ok', "two\nlines", "back\\slash", "", None, " padded "]
    df = spark.createDataFrame([(n, t, ["a", "b,c"]) for n, t in enumerate(odd)], "n int, t string, flags array<string>")
    index_store.export_csv(df, f"{shared}/csv")
    back = index_store.read_csv(spark, f"{shared}/csv", schemas.struct(n=schemas.INT, t=schemas.STRING, flags=schemas.STRING))
    assert [(r["t"], r["flags"]) for r in back.orderBy("n").collect()] == [(t, '["a","b,c"]') for t in odd]
    index_store.export_json(df, f"{shared}/json")
    assert [r["t"] for r in spark.read.schema(df.schema).json(f"{shared}/json").orderBy("n").collect()] == odd


def test_queues(spark):
    rows = [(n, s, datetime(2024, 1, n), c) for n, s, c in [(1, "approved", T0), (2, "approved", None), (3, "pending", None), (4, "approved", datetime(2023, 1, 1)), (5, "rejected", None)]]
    df = spark.createDataFrame(rows, "id long, status string, created_at timestamp, last_checked_at timestamp")
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(review.update_queue(df, 2)) == [2, 4]
    assert ids(review.pending_queue(df)) == [3] and ids(review.recent(df, 2)) == [5, 4]
    assert ids(review.listing(df, limit=2, offset=2)) == [3, 4] == ids(review.listing_after(df, 2, limit=2))
    assert ids(review.due_for_check(df, F.lit(datetime(2024, 1, 8)), n=9)) == [2, 3, 4, 1]
    assert ids(review.due_for_check(df, F.lit(datetime(2024, 1, 7)), n=9)) == [2, 3, 4]
    shown = {r["status"]: r["n"] for r in review.dashboard_rows(df).collect()}
    assert shown == {"pending": 1, "approved": 3, "rejected": 1, "risky": 0, "offline": 0, "total": 5}
    assert review.status_map(df).first()["counts"] == {"approved": 3, "pending": 1, "rejected": 1}


def test_ledger(spark, shared):
    log = index_store.EventLog(spark, f"{shared}/runs")
    assert log.read().count() == 0
    for run, last in ((1, None), (2, "started"), (3, "good"), (4, "bad")):
        log.append(ledger.event(spark, run, "created", T0, task_type="code_search", query_text="q"))
        if last:
            log.append(ledger.event(spark, run, "started", T0))
        if last == "good":
            log.append(ledger.event(spark, run, "finished", T1, found=5, saved=2, skipped=4))
        if last == "bad":
            log.append(ledger.event(spark, run, "finished", T1, found=5, saved=5, error="boom"))
    runs = {r["run_id"]: r for r in ledger.current_state(log.read().repartition(5)).collect()}
    assert [runs[n]["status"] for n in (1, 2, 3, 4)] == ["pending", "running", "success", "failed"]
    assert (runs[3]["total_found"], runs[3]["total_failed"], runs[3]["task_type"], runs[3]["finished_at"]) == (5, -1, "code_search", T1)
    assert runs[1]["started_at"] is None and runs[4]["error_message"] == "boom"
    assert tuple(ledger.run_stats(ledger.current_state(log.read())).first()) == (4, 1, 1, 1, 1)


def test_look_ups_are_pushed_down(spark, shared):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    store = index_store.IndexStore(spark, shared)
    store.publish(index(spark), T0)
    plan = review.by_repo_and_path(store.read(), "a/a", "p1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo_full_name,a/a)" in plan and "EqualTo(skill_path,p1)" in plan and "description" not in plan
    queue = review.update_queue(store.read(), 5).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in queue and "EqualTo(status,approved)" in queue


@pytest.mark.parametrize("broadcast", ["-1", "10mb"])
def test_merging_into_a_bucketed_index_keeps_its_layout(spark, shared, broadcast):
    store = index_store.IndexStore(spark, shared, buckets=4)
    rows = spark.range(4_000).select("id", F.concat(F.lit("o/r"), F.col("id") % 5).alias("repo_full_name"), F.col("id").cast("string").alias("skill_path"))
    store.publish(rows, T0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        fresh = rows.withColumns({"skill_path": (F.col("id") * 3).cast("string"), "stars": F.lit(1)}).drop("id")
        after = merge.upsert(store.read(), fresh, F.lit(T1), buckets=4)
        store.publish(after, T1, clustered=True)
        old = {(r["repo_full_name"], r["skill_path"]): r["id"] for r in store.read(1).collect()}
        new = {(r["repo_full_name"], r["skill_path"]): (r["id"], r["stars"]) for r in store.read(2).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(new) == store.read(2).count() > 4_000 and all(new[k][0] == old[k] for k in old)
    assert len(store.read(2).inputFiles()) <= 8
    # the files really lie by bucket: a merge that trusts the layout finds every key
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = store.read(2).join(spark.createDataFrame(list(new), "repo_full_name string, skill_path string"), KEY)
        assert again.count() == len(new)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def files_under(path):
    from pathlib import Path

    return {str(f.relative_to(path)): f.stat().st_size for f in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("buckets", [None, 3])
def test_change_rows_replace_rows_until_they_are_folded(spark, shared, buckets):
    store = index_store.IndexStore(spark, shared, buckets=buckets)
    changed = lambda status: merge.set_status(merge.rows_of(store.read(), status, ["id"]), status, F.lit(T1))
    status = lambda *rows: spark.createDataFrame(list(rows), "id long, new_status string")
    many = spark.range(1, 2001).selectExpr("id", "'a/a' AS repo_full_name", "concat('p', id) AS skill_path", "5 AS stars", "'pending' AS status")
    assert store.publish_changes(index_store.conform(many), T0) == 1  # the first version is whole
    before = files_under(shared)
    assert store.publish_changes(changed(status((1, "approved"), (2, "risky"), (9999, "approved"))), T1, "one") == 2
    assert store.publish_changes(changed(status((2, "rejected"))), T1) == 3
    assert store.publish_changes(store.read(), T1, "one") == 3
    written = {f: n for f, n in files_under(shared).items() if f not in before}
    assert sum(spark.read.parquet(f"{shared}/{f}").count() for f in written) == 3
    assert sum(written.values()) < sum(before.values())
    by = lambda df: {r.id: r.status for r in df.collect() if r.status != "pending"}
    assert by(store.read()) == {1: "approved", 2: "rejected"} and store.read().count() == 2000
    assert by(store.read(2)) == {1: "approved", 2: "risky"} and by(store.read(1)) == {} and store.read(8).count() == 0
    # a new key is a change as well, and a merge goes on from there
    fresh = index_store.conform(store.read().filter("id = 1").withColumns({"id": F.lit(3000).cast("long"), "skill_path": F.lit("new")}))
    assert store.publish_changes(fresh, T1) == 4 and store.read().count() == 2001
    merged = merge.upsert(store.read(), batch(spark), F.lit(T1), buckets=buckets)
    assert merged.count() == 2004
    state_before = state(store.read(), *schemas.INDEX.names)
    assert store.fold(T1) == 5 and store.fold(T1) == 5
    assert state(store.read(), *schemas.INDEX.names) == state_before
    assert store.publish_changes(changed(status((7, "offline"))), T1) == 6
    assert store.remove_old(keep=1) == [4, 3, 2, 1]  # the changes of version 6 need version 5
    assert by(store.read()) == {1: "approved", 2: "rejected", 7: "offline", 3000: "approved"}


def test_changes_of_a_store_with_another_key(spark, shared):
    store = index_store.IndexStore(spark, shared, schema=schemas.KNOWN_REPOS, key=["repo_full_name"])
    store.publish(index_store.conform(spark.createDataFrame([("a/a",), ("b/b",)], "repo_full_name string"), schemas.KNOWN_REPOS), T0)
    store.publish_changes(index_store.conform(spark.createDataFrame([("b/b", "x")], "repo_full_name string, source_level string"), schemas.KNOWN_REPOS), T1)
    assert {r.repo_full_name: r.source_level for r in store.read().collect()} == {"a/a": None, "b/b": "x"}


def test_keys_compare_under_a_collation(spark):
    ci = "UNICODE_CI_AI_RTRIM"
    rows = [("A/A", "p1", 50, "pending"), ("a/á", "P1 ", 60, "pending"), ("B/b ", "p1", 8, "pending"), ("c/c", "x", 1, "pending"), ("C/C", "x", 1, "pending"), (None, "p1", 4, "pending")]
    batch = spark.createDataFrame(rows, "repo_full_name string, skill_path string, stars int, status string")
    after = merge.upsert(index(spark), batch, F.lit(T1), collation=ci)
    got = state(after, "id", "stars")
    # known rows keep their spelling; of equal new keys the largest row counts; a NULL key equals none
    assert got == {("a/a", "p1"): (1, 60), ("a/a", "p2"): (2, 6), ("b/b", "p1"): (7, 8), ("c/c", "x"): (got["c/c", "x"][0], 1), (None, "p1"): (got[None, "p1"][0], 4)}
    assert after.schema == index(spark).schema
    assert merge.upsert(index(spark), batch, F.lit(T1)).count() == 9
    now = batch.withColumns({"skill_etag": F.lit(None).cast("string"), "skill_sha": F.lit("s")}).filter("repo_full_name IS NOT NULL")
    changes = {(r.repo_full_name, r.skill_path): r.change for r in merge.change_classes(index(spark), now, collation=ci).collect()}
    assert changes == {("a/a", "p1"): "modified", ("a/a", "p2"): "gone", ("b/b", "p1"): "modified", ("c/c", "x"): "new"}
    assert merge.new_keys(index(spark), now, ci).count() == 1
    assert [tuple(r) for r in merge.vanished_keys(index(spark), now, ci).collect()] == [("a/a", "p2")]
    none = now.limit(0)
    assert merge.upsert(index(spark), batch.limit(0), F.lit(T1), collation=ci).count() == 3
    assert merge.new_keys(index(spark), none, ci).count() == 0


def test_collated_keys_are_hashed_not_looped(spark):
    plan = merge.upsert(index(spark), batch(spark), F.lit(T1), collation="UNICODE_CI_AI_RTRIM")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_seen_under_a_collation(spark):
    from shelfmark.operators import dedup

    rows = [(1, 0, 0, "o/a", "x", "HTTP://A"), (0, 0, 0, "o/a", "x", "http://á "), (0, 1, 0, "o/b", "y", None), (2, 0, 0, "O/B", "Y", "")]
    hits = spark.createDataFrame(rows, "query_idx int, page int, pos int, repo_full_name string, skill_path string, html_url string")
    got = {r.hit_key: (r.n_seen, r.query_idx) for r in dedup.first_seen(hits, collation="UNICODE_CI_AI_RTRIM").collect()}
    assert got == {"http://á ": (2, 0), "o/b/y": (2, 0)}
    assert dedup.first_seen(hits).count() == 4
