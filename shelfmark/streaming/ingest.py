"""Landed files into the index, each exactly once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark import schemas
from shelfmark.functions.risk import DEFAULT_RULES
from shelfmark.operators import dedup, merge
from shelfmark.plans.records import CANDIDATE_COLUMNS, build_records, busy_candidates, saved_records
from shelfmark.session import remove, stage, staging
from shelfmark.sources import landing
from shelfmark.sources.index_store import IndexStore


def fetched_records(fetched: DataFrame, repos: DataFrame, layout: DataFrame, as_of: datetime, rules=DEFAULT_RULES) -> DataFrame:
    """The records of one batch of fetched files, one row per file, with the arrival ``seq``."""
    now = F.lit(as_of)
    # fetched more than once in a batch: the last answer counts
    once = dedup.last_wins(fetched, ["skill_api_url"], ["seq"], keep_first=())
    responses = once.select(
        F.col("skill_api_url").alias("api_url"), "status_code", "body", "etag", "last_modified", "payload"
    )
    candidates = once.select(*CANDIDATE_COLUMNS, "seq")
    built = build_records(candidates, landing.file_contents(responses), repos, layout, now, rules, busy_candidates(fetched))
    rows = stage(built, "dispositions")
    return dedup.last_wins(saved_records(rows, ["seq"]), schemas.KEY, ["seq"])


class Pending:
    """Records of micro-batches that are not in the index yet.

    A batch writes its records under its number and leaves the index alone; a run folds all
    of its batches into the index at once.
    """

    def __init__(self, store: IndexStore, name: str):
        self.store, self.name = store, name
        self.path = f"{store.root}/pending/{name}"
        self.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.INDEX.fields if f.name in schemas.RECORD_COLUMNS)

    def add(self, records: DataFrame, number: int) -> None:
        """Keep a batch; one that is replayed writes the same again."""
        records.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        """Records above the last folded batch, with ``batch``."""
        schema = f"{self.schema}, seq long, batch long"
        try:
            kept = self.store.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.store.spark.createDataFrame([], schema)
        return kept.filter(F.col("batch") > self._folded())

    def _folded(self) -> int:
        mine = self.store.commits.read().filter(F.col("batch_id").startswith(f"{self.name}#"))
        last = mine.agg(F.max(F.substring_index("batch_id", "#", -1).cast("long")).alias("n")).first()
        return -1 if last is None or last["n"] is None else last["n"]

    def fold(self, as_of: datetime) -> int:
        """Merge everything pending in one version; with nothing pending the index stays as it is."""
        rows = self.read()
        numbers = sorted(r["batch"] for r in rows.select("batch").distinct().collect())
        if not numbers:
            return self.store.version()
        upto = numbers[-1]
        with staging(self.store.spark):
            records = stage(dedup.last_wins(rows.drop("batch"), schemas.KEY, ["seq"]), "records")
            index = merge.upsert(self.store.read(), records, F.lit(as_of), buckets=self.store.buckets)
            version = self.store.publish(index, as_of, f"{self.name}#{upto}", clustered=self.store.version() > 0)
        self._remove_folded(numbers)
        return version

    def _remove_folded(self, numbers: list[int]) -> None:
        for number in numbers:
            remove(self.store.spark, f"{self.path}/batch={number}")


def ingest(
    spark: SparkSession,
    landing_dir: str,
    checkpoint: str,
    pending: Pending,
    repos: Callable[[], DataFrame],
    layout: Callable[[], DataFrame],
    as_of: datetime,
    max_files: int | None = None,
) -> int:
    """Take all files that arrived since the last run, then fold them into the index; gives its version.

    The last batch number is committed with the version, so what was folded before a crash
    is not folded again.
    """
    reader = spark.readStream.schema(schemas.FETCHED)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def keep(batch: DataFrame, number: int) -> None:
        with staging(spark):
            pending.add(fetched_records(batch, repos(), layout(), as_of), number)

    query: StreamingQuery = (
        reader.json(landing_dir)
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return pending.fold(as_of)
