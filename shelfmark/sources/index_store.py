"""The index on shared storage: immutable versions and a log of commits.

A version is an ordinary Parquet directory.  It becomes current when its row in
the commit log is written, so readers never see half a version and a failed job
leaves nothing behind that counts.  The row of a version has a directory of its
own, which a second writer of that version finds taken: it is refused.

A version holds the whole index, or only the rows that changed since the one before
(``publish_changes``).  A reader takes the last whole version and, for each key, the
newest of the change rows after it; ``fold`` writes that as a whole version.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import schemas
from shelfmark.operators import dedup
from shelfmark.session import remove


class ConcurrentWriter(RuntimeError):
    """Another writer has committed the version that was being written."""


class EventLog:
    """Append-only rows of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = schemas.RUN_EVENTS):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).coalesce(1).write.mode("append").json(self.path)

    def append_once(self, rows: DataFrame, name: str) -> None:
        """Append under a name; fails if the name is taken."""
        rows.select(*self.schema.names).coalesce(1).write.mode("errorifexists").json(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).json(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)


def conform(df: DataFrame, schema: T.StructType = schemas.INDEX) -> DataFrame:
    """Exactly the columns and types of the index; what is missing is NULL."""
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        return (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


class IndexStore:
    """Versioned index.

    With ``buckets`` the rows of a version are bucketed and sorted by key, and the
    joins of the next merge need no shuffle on the index side.  ``key`` says which
    rows a change row replaces.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = schemas.INDEX, buckets: int | None = None, key: list[str] = schemas.KEY):
        self.spark, self.root, self.schema, self.buckets, self.key = spark, root.rstrip("/"), schema, buckets, key
        self.commits = EventLog(spark, f"{self.root}/commits", schemas.COMMITS)

    def _last(self):
        return self.commits.read().orderBy(F.col("version").desc()).limit(1).first()

    def version(self) -> int:
        last = self._last()
        return last["version"] if last else 0

    def has_batch(self, batch_id: str) -> bool:
        return not self.commits.read().filter(F.col("batch_id") == batch_id).isEmpty()

    def _parts(self, version: int | None = None) -> list:
        """The commits that make up a version: a whole one, then its changes in order."""
        log = self.commits.read()
        if version is not None:
            log = log.filter(F.col("version") <= version)
        whole = log.filter(~F.coalesce("changes", F.lit(False))).agg(F.max("version")).first()[0]
        return [] if whole is None else log.filter(F.col("version") >= whole).orderBy("version").collect()

    def read(self, version: int | None = None) -> DataFrame:
        """A version, by default the last one; no rows for a version that does not exist."""
        parts = self._parts(version)
        if not parts or (version is not None and parts[-1]["version"] != version):
            return self.spark.createDataFrame([], self.schema)
        base, *changes = parts
        rows = self._bucketed(base["path"], base["buckets"]) if base["buckets"] else self.spark.read.schema(self.schema).parquet(base["path"])
        if not changes:
            return rows
        read = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_version", T.LongType())]))
        newest = read.parquet(*[c["path"] for c in changes])
        if len(changes) > 1:
            newest = dedup.last_wins(newest, self.key, ["_version"], keep_first=())
        newest = newest.select(*self.schema.names)
        if base["buckets"]:  # they lie by bucket as the others do
            newest = newest.repartition(base["buckets"], *self.key)
        return rows.join(newest.select(*self.key), self.key, "left_anti").select(*self.schema.names).unionByName(newest)

    def _table(self, path: str) -> str:
        return "shelfmark_" + path.rsplit("-", 1)[-1]

    def _bucketed(self, path: str, buckets: int) -> DataFrame:
        # A session without the table's metadata declares it again over the same files.
        keys = ", ".join(schemas.KEY)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table(path)} ({columns}) USING parquet LOCATION '{path}' "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS"
        )
        return self.spark.table(self._table(path))

    def publish(self, index: DataFrame, as_of: datetime, batch_id: str | None = None, clustered: bool = False) -> int:
        """Write the next version and commit it; a batch that was committed before changes nothing.

        ``clustered`` says that the rows come from the last version by a merge on the
        key and still lie together by bucket; other rows are brought together first.
        """
        if batch_id is not None and self.has_batch(batch_id):
            return self.version()
        version = self.version() + 1
        path = f"{self.root}/versions/v{version:08d}-{uuid.uuid4().hex}"
        rows = conform(index, self.schema)
        if self.buckets:
            by_key = rows if clustered else rows.repartition(self.buckets, *schemas.KEY)
            writer = by_key.write.bucketBy(self.buckets, *schemas.KEY).sortBy(*schemas.KEY)
            writer.option("path", path).format("parquet").saveAsTable(self._table(path))
        else:
            rows.write.parquet(path)
        return self._commit(version, path, batch_id, as_of, self.buckets, False)

    def publish_changes(self, rows: DataFrame, as_of: datetime, batch_id: str | None = None) -> int:
        """Commit a version that differs from the last one by these whole rows, one for each key.

        Nothing else is written.  The first version of an index is a whole one.
        """
        if batch_id is not None and self.has_batch(batch_id):
            return self.version()
        last = self.version()
        if not last:
            return self.publish(rows, as_of, batch_id)
        path = f"{self.root}/changes/v{last + 1:08d}-{uuid.uuid4().hex}"
        conform(rows, self.schema).withColumn("_version", F.lit(last + 1).cast("long")).write.parquet(path)
        return self._commit(last + 1, path, batch_id, as_of, None, True)

    def fold(self, as_of: datetime) -> int:
        """Write the last version as a whole one if it consists of changes."""
        return self.publish(self.read(), as_of) if len(self._parts()) > 1 else self.version()

    def _commit(self, version: int, path: str, batch_id: str | None, as_of: datetime, buckets: int | None, changes: bool) -> int:
        commit = [(version, path, batch_id, buckets, as_of, changes)]
        try:
            self.commits.append_once(self.spark.createDataFrame(commit, schemas.COMMITS), f"v{version:08d}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise ConcurrentWriter(f"version {version} was written by another writer meanwhile") from error
        return version

    def remove_old(self, keep: int = 2) -> list[int]:
        """Remove the files and tables that the last ``keep`` versions do not need; the commit log stays."""
        every = self.commits.read().orderBy(F.col("version").desc()).collect()
        first = every[: max(1, keep)][-1]["version"] if every else 0
        # a version of changes needs the whole one before it, and the changes between
        whole = max((r["version"] for r in every if r["version"] <= first and not r["changes"]), default=first)
        old = [r for r in every if r["version"] < whole]
        for row in old:
            if row["buckets"]:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(row['path'])}")
            remove(self.spark, row["path"])
        return [row["version"] for row in old]


def export_csv(index: DataFrame, path: str) -> None:
    """CSV with a header; lists become JSON text because CSV has none."""
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
        for f in index.schema.fields
    ]
    # quotes are doubled, line ends stay inside quotes, spaces stay, and empty text differs from NULL
    writer = index.select(*flat).write.option("header", True).option("escape", '"').option("nullValue", "\\N")
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
    return reader.option("nullValue", "\\N").csv(path)


def export_json(index: DataFrame, path: str) -> None:
    index.write.option("ignoreNullFields", False).json(path)
