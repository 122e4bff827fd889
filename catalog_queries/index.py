"""M: changes to the index.  T: queues and listings."""

from pyspark.sql import functions as F

from catalog_queries import sqltext as q
from catalog_queries.registry import as_of, query, text_time
from shelfmark import schemas
from shelfmark.operators import ledger, merge, review
from shelfmark.sources import known_repos
from shelfmark.sources.index_store import conform

_TYPES = {f.name: f.dataType.simpleString() for f in schemas.INDEX.fields}
# what the previous snapshot has; its other columns are NULL
_OLD = {"name", "skill_sha", "skill_etag", "skill_api_url", "stars", "status", "risk_level", "last_checked_at", "first_found_at"}
# what an upsert takes from its batch
_WRITTEN = [c for c in schemas.RECORD_COLUMNS if c not in (*schemas.KEY, "first_found_at")]


def _given(name: str) -> str:
    """A value of the batch, in the SQL of either engine; lists as text."""
    fixed = {"skill_sha": "sha", "stars": "CAST(size % 300 AS INT)", "status": "'pending'", "risk_level": "'medium'", "last_checked_at": f"CAST('{q.AS_OF}' AS TIMESTAMP)"}
    if name in fixed:
        return fixed[name]
    place = schemas.INDEX.names.index(name)
    if _TYPES[name] in ("int", "smallint"):
        return f"CAST((doc_id + {place}) % {2 if _TYPES[name] == 'smallint' else 97} AS INT)"
    if _TYPES[name] == "timestamp":
        return f"CAST(DATE '2024-01-01' + CAST((doc_id + {place}) % 40 AS INT) AS TIMESTAMP)"
    return f"'{name},' || CAST(doc_id AS STRING)"


def _shown(index):
    """Every column of the index."""
    def column(name):
        kind = _TYPES[name]
        return {"timestamp": text_time(name), "smallint": F.col(name).cast("int").alias(name), "array<string>": F.array_join(name, ",").alias(name)}.get(kind, F.col(name))

    return index.select(*[column(c) for c in index.columns])


_NEW_ID = """(SELECT max(id) FROM skill_index) + row_number() OVER (PARTITION BY x.id IS NULL
    ORDER BY substr(md5(b.repo_full_name || '/' || b.skill_path), 1, 3), b.repo_full_name, b.skill_path)"""


def _same(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in schemas.KEY)


def _upsert_sql(status: str, batch_keys: str = "repo_full_name, skill_path", same: str = _same("x", "b")) -> str:
    def after(name):
        old = f"x.{name}" if name in _OLD else "NULL"
        new = f"b.{name}"
        if _TYPES[name] == "timestamp":
            old, new = q.ts(old) if name in _OLD else "NULL", q.ts(new)
        return status if name == "status" else f"CASE WHEN b.skill_path IS NULL THEN {old} ELSE {new} END"

    given = ", ".join(f"{_given(c)} AS {c}" for c in _WRITTEN)
    return f"""WITH b AS (SELECT {batch_keys}, {given} FROM skill_files)
SELECT CASE WHEN x.id IS NULL THEN {_NEW_ID} ELSE x.id END AS id, coalesce(x.repo_full_name, b.repo_full_name) AS repo_full_name,
  coalesce(x.skill_path, b.skill_path) AS skill_path, {", ".join(f"{after(c)} AS {c}" for c in _WRITTEN)},
  CASE WHEN x.id IS NULL THEN '{q.AS_OF}' ELSE {q.ts('x.first_found_at')} END AS first_found_at,
  CASE WHEN x.id IS NULL THEN '{q.AS_OF}' ELSE {q.ts('x.created_at')} END AS created_at,
  CASE WHEN b.skill_path IS NULL THEN {q.ts('x.updated_at')} ELSE '{q.AS_OF}' END AS updated_at
FROM skill_index x FULL JOIN b ON {same}"""


def _batch(files):
    def column(name):
        return F.split(F.expr(_given(name)), ",") if _TYPES[name].startswith("array") else F.expr(_given(name)).cast(_TYPES[name])

    return files.select(*schemas.KEY, as_of().alias("first_found_at"), *[column(c).alias(c) for c in _WRITTEN])


@query("m1_upsert", _upsert_sql("CASE WHEN b.skill_path IS NULL THEN x.status ELSE b.status END"))
def _(i):
    return _shown(merge.upsert(conform(i.skill_index), _batch(i.skill_files), as_of()))


@query(
    "m1_upsert_preserving_review",
    _upsert_sql("CASE WHEN b.skill_path IS NULL OR x.status IN ('approved', 'rejected', 'risky') THEN x.status ELSE b.status END"),
)
def _(i):
    return _shown(merge.upsert(conform(i.skill_index), _batch(i.skill_files), as_of(), preserve_review=True))


# ---------------------------------------------------------------- keys under a collation
# the same keys in capitals, with accents, with spaces behind them, and as they are
_RESPELLED = """CASE doc_id % 4 WHEN 0 THEN upper(repo_full_name) WHEN 1 THEN replace(repo_full_name, 'o', 'ö') WHEN 2 THEN repo_full_name || '  ' ELSE repo_full_name END AS repo_full_name,
  CASE doc_id % 3 WHEN 0 THEN skill_path || ' ' WHEN 1 THEN replace(lower(skill_path), 'e', 'é') ELSE skill_path END AS skill_path"""


_SAME_COLLATED = " AND ".join(f"{q.collated(f'x.{k}')} = {q.collated(f'b.{k}')}" for k in schemas.KEY)


def _respelled(i):
    return i.skill_files.selectExpr("doc_id", "sha", "size", *_RESPELLED.split(",\n"))


@query("d9_upsert_collated", _upsert_sql("CASE WHEN b.skill_path IS NULL THEN x.status ELSE b.status END", _RESPELLED, _SAME_COLLATED))
def _(i):
    return _shown(merge.upsert(conform(i.skill_index), _batch(_respelled(i)), as_of(), collation=q.COLLATION))


@query(
    "d9_changes_collated",
    f"""WITH b AS (SELECT {_RESPELLED}, sha FROM skill_files)
SELECT coalesce(x.repo_full_name, b.repo_full_name) AS repo_full_name, coalesce(x.skill_path, b.skill_path) AS skill_path,
  CASE WHEN x.id IS NULL THEN 'new' WHEN b.skill_path IS NULL THEN 'gone' WHEN x.skill_sha = b.sha THEN 'unchanged' ELSE 'modified' END AS change
FROM skill_index x FULL JOIN b ON {_SAME_COLLATED}""",
)
def _(i):
    return merge.change_classes(i.skill_index, _respelled(i).withColumnRenamed("sha", "skill_sha"), validator="skill_sha", collation=q.COLLATION)


# every document asks for the row twice its number, so that half of the ids are unknown
_CHANGE_SQL = "c AS (SELECT doc_id * 2 + 1 AS id, CASE doc_id % 2 WHEN 0 THEN 'approved' ELSE 'rejected' END AS new_status FROM skill_files)"


def _changes(i):
    status = F.when(F.col("doc_id") % 2 == 0, "approved").otherwise("rejected")
    return i.skill_files.select((F.col("doc_id") * 2 + 1).alias("id"), status.alias("new_status"))


@query(
    "m2_set_status",
    f"""WITH {_CHANGE_SQL}
SELECT x.id, coalesce(c.new_status, x.status) AS status, CASE WHEN c.id IS NULL THEN {q.ts('x.updated_at')} ELSE '{q.AS_OF}' END AS updated_at
FROM skill_index x LEFT JOIN c ON c.id = x.id""",
)
def _(i):
    return merge.set_status(i.skill_index, _changes(i), as_of()).select("id", "status", text_time("updated_at"))


@query(
    "m2_repeated_ids",
    f"""WITH {_CHANGE_SQL}
SELECT x.id, coalesce(c.new_status, x.status) AS status, CASE WHEN c.id IS NULL THEN {q.ts('x.updated_at')} ELSE '{q.AS_OF}' END AS updated_at
FROM skill_index x LEFT JOIN c ON c.id = x.id""",
)
def _(i):
    # each change comes after another one of the same row
    last = _changes(i).withColumn("at", F.lit(2))
    earlier = last.withColumns({"new_status": F.lit("risky"), "at": F.lit(1)})
    changed = merge.set_status(i.skill_index, last.unionByName(earlier), as_of(), order=["at"])
    return changed.select("id", "status", text_time("updated_at"))


@query(
    "m2_status_results",
    f"WITH {_CHANGE_SQL} SELECT c.id, new_status, CAST(c.id IN (SELECT id FROM skill_index) AS INT) AS applied FROM c",
)
def _(i):
    return merge.status_results(i.skill_index, _changes(i)).withColumn("applied", F.col("applied").cast("int"))


@query(
    "m3_mark_offline",
    f"""WITH {_CHANGE_SQL}
SELECT x.id, CASE WHEN c.id IS NULL THEN x.status ELSE 'offline' END AS status, CASE WHEN c.id IS NULL THEN {q.ts('x.updated_at')} ELSE '{q.AS_OF}' END AS updated_at
FROM skill_index x LEFT JOIN c ON c.id = x.id""",
)
def _(i):
    return merge.mark_offline(i.skill_index, _changes(i), as_of()).select("id", "status", text_time("updated_at"))


@query(
    "m4_touch_checked",
    f"""WITH {_CHANGE_SQL}
SELECT x.id, CASE WHEN c.id IS NULL THEN {q.ts('x.last_checked_at')} ELSE '{q.AS_OF}' END AS last_checked_at,
  CASE WHEN c.id IS NULL THEN {q.ts('x.updated_at')} ELSE '{q.AS_OF}' END AS updated_at
FROM skill_index x LEFT JOIN c ON c.id = x.id""",
)
def _(i):
    touched = merge.touch_checked(i.skill_index, _changes(i), as_of())
    return touched.select("id", text_time("last_checked_at"), text_time("updated_at"))


@query(
    "m5_touch_scanned",
    f"""SELECT repo_full_name, source_level, CASE WHEN repo_full_name IN (SELECT repo_full_name FROM skill_files) THEN '{q.AS_OF}' END AS last_scanned_at
FROM known_repos""",
)
def _(i):
    touched = known_repos.touch_scanned(i.known_repos, i.skill_files, as_of())
    return touched.select("repo_full_name", "source_level", text_time("last_scanned_at"))


@query(
    "m6_bulk_approve",
    f"""SELECT id, CASE WHEN stars > 100 AND risk_level = 'low' AND status = 'pending' THEN 'approved' ELSE status END AS status,
  CASE WHEN stars > 100 AND risk_level = 'low' AND status = 'pending' THEN '{q.AS_OF}' ELSE {q.ts('updated_at')} END AS updated_at FROM skill_index""",
)
def _(i):
    return merge.bulk_approve(i.skill_index, as_of()).select("id", "status", text_time("updated_at"))


@query("m7_bulk_risky", "SELECT id, CASE WHEN risk_level = 'high' AND status = 'pending' THEN 'risky' ELSE status END AS status FROM skill_index")
def _(i):
    return merge.bulk_risky(i.skill_index, as_of()).select("id", "status")


@query(
    "m7_bulk_review",
    """SELECT id, CASE WHEN stars > 100 AND risk_level = 'low' AND status = 'pending' THEN 'approved'
  WHEN risk_level = 'high' AND status = 'pending' THEN 'risky' ELSE status END AS status FROM skill_index""",
)
def _(i):
    return merge.bulk_review(i.skill_index, as_of()).select("id", "status")


@query(
    "m8_run_ledger",
    f"""SELECT id AS run_id, task_type, status, CASE WHEN status = 'success' THEN total_found ELSE 0 END AS total_found,
  CASE WHEN status = 'success' THEN total_saved ELSE 0 END AS total_saved, CASE WHEN status = 'success' THEN total_skipped ELSE 0 END AS total_skipped,
  CASE WHEN status = 'success' THEN total_found - total_saved - total_skipped ELSE 0 END AS total_failed,
  CASE WHEN status = 'failed' THEN 'boom' END AS error_message, {q.ts('created_at')} AS created_at,
  CASE WHEN status <> 'pending' THEN {q.ts("created_at + INTERVAL 1 HOUR")} END AS started_at,
  CASE WHEN status IN ('success', 'failed') THEN {q.ts("created_at + INTERVAL 2 HOUR")} END AS finished_at FROM scan_tasks""",
)
def _(i):
    seqs = F.when(F.col("status") == "pending", F.array(F.lit(0))).when(
        F.col("status") == "running", F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    done, won = F.col("seq") == 2, F.col("status") == "success"
    started = i.scan_tasks.withColumn("seq", F.explode(seqs))
    events = started.select(
        F.col("id").alias("run_id"),
        "seq",
        F.element_at(F.array(*map(F.lit, ["created", "started", "finished"])), F.col("seq") + 1).alias("event"),
        F.when(F.col("seq") == 0, F.col("task_type")).alias("task_type"),
        F.lit(None).cast("string").alias("query_text"),
        *[F.when(done & won, F.col(t)).cast("bigint").alias(t) for t in ("total_found", "total_saved", "total_skipped")],
        F.when(done & ~won, "boom").alias("error_message"),
        (F.col("created_at").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("seq"))).alias("at"),
    )
    state = ledger.current_state(events).drop("query_text")
    return state.withColumns({c: text_time(c) for c in ("created_at", "started_at", "finished_at")})


# ---------------------------------------------------------------- queues and listings
@query("t1_pending_queue", f"SELECT id, status, {q.ts('created_at')} AS created_at FROM skill_index WHERE status = 'pending' ORDER BY skill_index.created_at DESC, id LIMIT 100")
def _(i):
    return review.pending_queue(i.skill_index).select("id", "status", text_time("created_at"))


@query(
    "t2_update_queue",
    f"SELECT id, {q.ts('last_checked_at')} AS last_checked_at FROM skill_index WHERE status = 'approved' ORDER BY skill_index.last_checked_at NULLS FIRST, id LIMIT 100",
)
def _(i):
    return review.update_queue(i.skill_index).select("id", text_time("last_checked_at"))


@query("t3_recent_rows", f"SELECT id, name, stars, {q.ts('created_at')} AS created_at FROM skill_index ORDER BY skill_index.created_at DESC, id LIMIT 5")
def _(i):
    return review.recent(i.skill_index).select("id", "name", "stars", text_time("created_at"))


@query(
    "t4_recent_runs",
    "SELECT id, task_type, status, total_found, total_saved FROM scan_tasks ORDER BY created_at DESC, id DESC LIMIT 10",
)
def _(i):
    return ledger.recent_runs(i.scan_tasks)


@query("t5_listing", "SELECT id, status FROM skill_index WHERE status = 'approved' ORDER BY id LIMIT 50 OFFSET 100")
def _(i):
    return review.listing(i.skill_index, "approved", limit=50, offset=100).select("id", "status")


@query("t5_listing_after", "SELECT id, status FROM skill_index WHERE id > 500 ORDER BY id LIMIT 50")
def _(i):
    return review.listing_after(i.skill_index, 500, limit=50).select("id", "status")


@query(
    "t6_due_for_check",
    f"""WITH p(status, days) AS (VALUES ('pending', 1), ('approved', 7), ('risky', 14), ('offline', 30))
SELECT x.id, x.status, {q.ts('last_checked_at')} AS last_checked_at FROM skill_index x JOIN p ON p.status = x.status
WHERE x.last_checked_at IS NULL OR x.last_checked_at + to_days(p.days) <= TIMESTAMP '{q.AS_OF}'""",
)
def _(i):
    return review.due_for_check(i.skill_index, as_of()).select("id", "status", text_time("last_checked_at"))
