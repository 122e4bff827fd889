"""Runs with effects: stage, merge, publish, and enter the result in the ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import counters, dedup, ledger, merge
from shelfmark.plans import refresh
from shelfmark.plans.records import saved_records
from shelfmark.session import stage, staging
from shelfmark.sources import known_repos
from shelfmark.sources.index_store import EventLog, IndexStore


# What decides between records of one file that arrived in no known order.
UNORDERED = ["skill_sha", "skill_etag", "name"]


@dataclass
class Run:
    """Who runs: the store to merge into, the ledger to write, and the time that counts as now."""

    store: IndexStore
    log: EventLog
    run_id: int
    as_of: datetime
    collation: str | None = None  # how keys compare; by bytes without one

    def _event(self, name: str, **fields) -> None:
        self.log.append(ledger.event(self.store.spark, self.run_id, name, self.as_of, **fields))

    def _recorded(self, task_type: str, text: str, work: Callable[[], tuple[dict, tuple[int, int, int]]]) -> dict:
        self._event("created", task_type=task_type, query_text=text)
        self._event("started")
        try:
            with staging(self.store.spark):
                totals, (found, saved, skipped) = work()
        except Exception as error:
            self._event("finished", error=str(error) or type(error).__name__)
            raise
        self._event("finished", found=found, saved=saved, skipped=skipped)
        return totals

    def acquire(
        self,
        task_type: str,
        text: str,
        dispositions: Callable[[], DataFrame],
        arrival: list[str] | None = None,
        preserve_review: bool = False,
        batch_id: str | None = None,
    ) -> dict:
        """Evaluate a discovery route once, merge its records and return its counters."""
        now = F.lit(self.as_of)

        def work():
            rows = dispositions()
            records = saved_records(rows, arrival)
            # a file may be found on several routes; the merge reads its batch several times, and its true size decides how it joins
            keyed, by = dedup.compared(records, schemas.KEY, self.collation)
            records = stage(dedup.last_wins(keyed, by, arrival or UNORDERED).select(*schemas.RECORD_COLUMNS), "records")
            old, buckets = self.store.read(), self.store.buckets
            index = merge.upsert(old, records, now, preserve_review=preserve_review, buckets=buckets, collation=self.collation)
            clustered = self.store.version() > 0 and self.collation is None
            self.store.publish(index, self.as_of, batch_id, clustered=clustered)
            totals = counters.acquisition_counters(rows).first().asDict()
            return totals, (totals["total_found"], totals["total_saved"], totals["total_skipped"])

        return self._recorded(task_type, text, work)

    def scan(self, known: IndexStore, text: str, scope: DataFrame, dispositions: Callable[[], DataFrame]) -> dict:
        """A scan of known repositories; those in scope are then stamped in their own store."""
        totals = self.acquire("repo_tree", text, dispositions)
        known.publish(known_repos.touch_scanned(known.read(), scope, F.lit(self.as_of)), self.as_of)
        return totals

    def refresh(self, contents: DataFrame, repos: DataFrame, layout: DataFrame, limit: int | None = 100) -> dict:
        """Re-check the rows that waited longest; with none to check it finishes with zeros."""
        now = F.lit(self.as_of)

        def work():
            index = self.store.read()
            changes = refresh.plan_refresh(index, contents, repos, layout, limit)
            self.store.publish_changes(refresh.changed_rows(index, changes, now), self.as_of)
            totals = counters.refresh_counters(changes).first().asDict()
            return totals, (totals["checked"], totals["updated"], totals["not_modified"])

        label = "all" if limit is None else str(limit)
        return self._recorded("update_check", f"Checking {label} skills", work)

    def review(self, changes: DataFrame, order: list[str] | None = None) -> int:
        """Apply (id, new_status) and write the rows that it changes; gives the new version."""
        with staging(self.store.spark):
            asked = stage(changes.select("id", "new_status", *(order or [])), "asked")
            rows = merge.set_status(merge.rows_of(self.store.read(), asked, ["id"]), asked, F.lit(self.as_of), order)
            return self.store.publish_changes(rows, self.as_of)
